"""Spark jobs for site-by-time panels, and (in ``tessella.llm``) for training-data corpora."""
