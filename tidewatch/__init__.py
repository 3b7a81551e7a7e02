"""tidewatch: security-log analytics written as plain PySpark jobs."""

__version__ = "0.1.0"
