"""Packs trees of text files, or tables of texts, into bundles with a token budget, as Spark plans."""
