"""tessella: a Spark-native engine that turns rasters and tables into dot relations and back."""

__version__ = "0.1.0"
