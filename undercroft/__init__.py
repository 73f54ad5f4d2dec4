"""Incident-risk analytics over alarm journals, written for Apache Spark."""

__version__ = "0.1.0"
