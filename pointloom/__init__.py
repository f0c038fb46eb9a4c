"""Point-cloud analytics as Spark plans."""
