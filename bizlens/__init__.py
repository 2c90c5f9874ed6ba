"""Business analytics over star schemas and event feeds, as Spark DataFrame functions."""
