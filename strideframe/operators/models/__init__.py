"""Classifiers, clusterings and sequence models whose passes over rows are Spark jobs."""
