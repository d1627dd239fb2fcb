"""Operators over normalised electrocardiogram tables: each takes and returns DataFrames."""
