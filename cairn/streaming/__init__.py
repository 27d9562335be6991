"""Queries over batches that arrive one after the other."""
