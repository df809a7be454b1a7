"""Training-data operators: packing, deduplication, mixing, filtering and scoring of text corpora.

Nothing else in the package imports this subpackage; it imports nothing from the rest either.
"""
