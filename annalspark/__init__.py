"""A PySpark-native analytics engine for version-control history."""

__version__ = "0.1.0"
