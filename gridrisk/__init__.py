"""Daily gridded risk analytics as lazy Spark DataFrame transformations."""
