"""netquill: network-flow behaviour analytics as Spark DataFrame plans."""

__version__ = "1.0.0"
