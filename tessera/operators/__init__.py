"""Operators over frames of nodes, edges, vectors, candidates and events."""
