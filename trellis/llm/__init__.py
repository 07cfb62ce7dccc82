"""Training-data pipeline operators: filters, deduplication, search, tokenising and mixing.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
