"""knotwork: a PySpark-native property-graph, vector-retrieval and versioned-resource engine."""

__version__ = "0.1.0"
