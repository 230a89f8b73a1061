"""Funding-opportunity analytics on Spark."""
