"""Training-data operators: search, token accounting, chat rendering, quality, mixing, packing, dedup, sharding.

Nothing else in the library imports this package; ``__spark_entry__.py`` adds its queries when it is present.
"""
