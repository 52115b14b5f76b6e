"""sparkloom: a Spark-native engine for graph-pattern, market, assembly and reasoning analytics."""

__version__ = "0.1.0"
