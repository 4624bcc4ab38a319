"""Options, their resolution, and the plans from a source to a result."""
