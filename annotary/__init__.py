"""Annotation corpora and segmentation evaluation as Spark DataFrames."""

__version__ = "0.1.0"
