"""Explainable analytics over a typed media knowledge graph, as Spark jobs."""
