"""Incremental use of the batch operators."""
