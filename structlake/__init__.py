"""Structure and prediction analytics as Spark DataFrame transformations."""
