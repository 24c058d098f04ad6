"""Corpus analytics on Spark: record resolution, quality policy, windowed divergence and graph measures."""

__version__ = "0.1.0"
