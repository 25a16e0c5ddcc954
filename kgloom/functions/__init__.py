"""Part of the knowledge-graph engine."""
