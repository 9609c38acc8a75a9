"""Market-data analytics as Spark DataFrame transformations."""
