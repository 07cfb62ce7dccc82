"""Catalogue analytics on Spark: directory queries, metrics, review queues, parsing, matching and trust."""
