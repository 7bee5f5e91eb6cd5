"""Operators on texts for training data: packing, mixing, abusive content. Nothing outside imports this package."""
