"""Split-audit engine: declarative PySpark plans for auditing machine-learning datasets."""
