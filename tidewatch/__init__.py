"""Anomaly detection on ordered streams, as Spark plans."""

__version__ = "0.5.0"
