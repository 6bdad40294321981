"""Content notes, topic notes and their links as DataFrames."""
