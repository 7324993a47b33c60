"""Training-data operators: ten methods over documents, vectors, pages and conversations."""
