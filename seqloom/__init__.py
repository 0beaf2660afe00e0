"""seqloom: sequence analytics as lazy DataFrame operators on Apache Spark."""

__version__ = "0.1.0"
