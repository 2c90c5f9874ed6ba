"""Generic relational operators: aggregation, ordering, joins, integrity, linking."""
