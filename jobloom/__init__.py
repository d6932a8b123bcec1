"""A PySpark-native engine for job-listing data."""
