"""Subpackage of cytoframe."""
