"""Outage and reliability analytics as PySpark DataFrame operators."""
