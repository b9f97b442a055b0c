"""Operators over notes, meta events, vectors and predictions, as DataFrame plans."""
