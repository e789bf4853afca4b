"""domainlab: domain-name preparation, encoding and evaluation on Spark DataFrames."""

__version__ = "0.1.0"
