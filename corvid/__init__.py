"""corvid: DataFrame-in, DataFrame-out analytics and simple supervised learning on Spark."""

__version__ = "0.1.0"
