"""Workload and serving analytics as Spark DataFrame operators."""
