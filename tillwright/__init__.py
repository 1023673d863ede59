"""Revenue KPIs, anomaly detection and root-cause analysis on Spark DataFrames."""

__version__ = "0.1.0"
