"""Tessera: a Spark-first engine for property-graph retrieval and corpus analytics."""
