"""Whole facts, panels and serving queries, composed of operators."""
