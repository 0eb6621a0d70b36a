"""Whole analyses composed of operators, and the registered queries over the star-schema tables."""
