"""braidframe: dataflow, tabular, metadata and training-data operators written against PySpark."""

__version__ = "0.1.0"
