"""Training-data operators on documents, pages and vectors; nothing outside this package imports it."""
