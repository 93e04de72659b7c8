"""Public-transport analytics as Spark DataFrame programs."""
