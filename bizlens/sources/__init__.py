"""Readers, sinks, the calendar and the mapping of warehouse tables to the logical star."""
