"""Routing-anomaly analytics on Spark."""
