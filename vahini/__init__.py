"""vahini: data-quality dataflow and procurement analytics on Spark DataFrames."""

__version__ = "0.1.0"
