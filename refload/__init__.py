"""Loading, checking and versioning shared lookup tables with Spark."""
