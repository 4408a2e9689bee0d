"""lakeloom: a Spark-native engine for catalogued, labelled record collections."""

__version__ = "0.1.0"
