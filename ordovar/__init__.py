"""Sorting of large tables by ten interchangeable strategies, and the study of them, on Spark."""
