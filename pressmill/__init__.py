"""Article cleaning and text analytics as Spark DataFrame operators."""
