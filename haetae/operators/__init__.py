"""Relational operators: detection, masking, summaries."""
