"""Evidence, conflict and retrieval analytics as Spark jobs."""
