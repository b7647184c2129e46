"""Catalogue analytics on Spark: DataFrame operators, text extractors and named plans."""
