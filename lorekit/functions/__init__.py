"""Column functions and text parsers."""
