"""Activation analysis of language models as Spark jobs."""
