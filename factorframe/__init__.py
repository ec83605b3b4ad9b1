"""Factor-panel analytics on Spark: every operator is DataFrame -> DataFrame."""

__version__ = "0.1.0"
