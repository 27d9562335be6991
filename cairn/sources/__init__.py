"""Readers of point files and generators of points."""
