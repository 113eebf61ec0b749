"""quillon: a Spark-native analytics engine for audit, risk and corpus data."""

__version__ = "0.1.0"
