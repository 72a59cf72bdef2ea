"""Trajectory similarity search on PySpark: discrete Frechet range, kNN and batch queries."""
