"""Operators composed into whole runs, and the queries over the sample tables."""
