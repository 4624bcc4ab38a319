"""Where files come from: directory trees, ignore files, tables."""
