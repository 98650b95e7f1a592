"""Readers: text decoding, paragraphs, container formats."""
