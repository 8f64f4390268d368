"""Point-in-time feature engineering and model diagnostics on Spark DataFrames."""

__version__ = "0.1.0"
