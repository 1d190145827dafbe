"""A Spark-native engine for data quality, reconciliation and audit of multi-source facts."""
