"""Report plans: the spec table of observation questions and the line-list assembly."""
