"""Code-knowledge analytics as Spark DataFrame plans."""
