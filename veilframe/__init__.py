"""Span-level privacy analytics over DataFrames: detect, mask, align, measure."""
