"""Column expressions. Everything here is a built-in Spark expression; nothing runs in Python."""
