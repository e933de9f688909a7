"""Spark jobs for a searchable collection of research figures and tables."""
