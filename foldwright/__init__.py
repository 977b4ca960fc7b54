"""A PySpark-native workbench for the tabular machine-learning lifecycle."""
__version__ = "0.3.0"
