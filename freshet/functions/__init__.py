"""Scalar functions of the pipeline language."""
