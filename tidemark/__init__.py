"""Retrieval, memory and conversation analytics as Spark jobs."""
