"""Training-data operators: scoring, deduplication, filtering, mixing and binary output.

Self-contained: it imports nothing from the rest of the library and the rest imports nothing from it.
"""
