"""cloudloom: point-cloud files and large-scale record processing on PySpark."""

__version__ = "0.1.0"
