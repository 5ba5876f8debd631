"""Analyses as lazy ``DataFrame -> DataFrame`` functions, one module per subject."""
