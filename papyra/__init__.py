"""Papyra: text retrieval and narrative-graph analytics as Spark jobs."""
