"""Arborlens: code-graph analytics and corpus preparation as Spark DataFrame plans."""
