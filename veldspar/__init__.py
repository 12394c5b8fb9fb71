"""Spark-native registration analytics engine: DataFrame-to-DataFrame operators planned by Catalyst."""

__version__ = "0.1.0"
