"""Retail customer segmentation on Spark: invoice lines in, segments out."""
