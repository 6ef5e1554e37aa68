"""Financial-crime analytics as DataFrame programs on Apache Spark."""
