"""quern: a PySpark-native analytics engine built from lazy DataFrame operators."""

__version__ = "0.1.0"
