"""Training-data operators for text corpora, and their query bindings."""
