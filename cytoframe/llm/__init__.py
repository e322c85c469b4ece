"""Operators for preparing training text. Nothing else in cytoframe imports this subpackage."""
