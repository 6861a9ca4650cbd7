"""Operators for preparing training text: near-duplicates, tokens, packing, repeats, fingerprints, filters, mixes, search, archives.

Every operator takes DataFrames and returns DataFrames, works on whole texts and
all rows, and reads only the columns it names, so extra columns (also ones that
clash with its own working names) are harmless. Nothing else in the library
imports this subpackage.
"""
