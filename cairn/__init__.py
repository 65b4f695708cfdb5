"""cairn: a PySpark-native engine for US postal addresses and large record sets."""

__version__ = "0.1.0"
