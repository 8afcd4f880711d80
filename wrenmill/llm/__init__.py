"""Training-data operators on text, vectors and match groups. Nothing else in the library imports this package."""
