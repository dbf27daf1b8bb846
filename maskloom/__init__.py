"""Preparation and evaluation of text corpora for masked language models, as Spark jobs."""
