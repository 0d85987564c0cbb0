"""Spark-native analytics over forensic evidence: files, timelines, byte volumes and text corpora."""

__version__ = "0.1.0"
