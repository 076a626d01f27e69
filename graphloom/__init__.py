"""graphloom: a Spark-native analytics engine for code graphs and the corpora around them."""

__version__ = "0.1.0"
