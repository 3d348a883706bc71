"""Corpus integrity analytics expressed as Spark DataFrame plans."""
