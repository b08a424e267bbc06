"""Evaluation analytics for detection systems, and corpus preparation, as Spark jobs."""
