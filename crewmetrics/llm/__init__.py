"""Training-data operators: filters, near-duplicates, privacy, scoring, packing, archives.

Nothing else in the library imports this package; it imports only itself.
"""
