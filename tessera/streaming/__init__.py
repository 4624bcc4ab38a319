"""The same transforms on a stream of files."""
