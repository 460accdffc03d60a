"""Labelled-trial and retrieval-experiment analytics as Spark jobs."""
