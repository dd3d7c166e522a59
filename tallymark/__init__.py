"""Spark jobs for preparing labelled text and scoring the decisions made on it."""
