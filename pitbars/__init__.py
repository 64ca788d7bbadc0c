"""Point-in-time bar and event-study operators for PySpark DataFrames."""
