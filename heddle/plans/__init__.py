"""Composed queries and the registry behind ``__spark_entry__``."""
