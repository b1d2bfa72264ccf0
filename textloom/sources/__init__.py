"""Inputs: files, text columns, catalogs of readings, corpora."""
