"""Training-data operators: text, media, dedup, sharding, packing and URL jobs over whole corpora.

Nothing else in the library imports this subpackage.
"""
