"""Training-data operators on web-scale text tables; nothing else in the library imports this package."""
