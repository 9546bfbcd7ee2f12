"""Concept evolution analytics over dated text corpora, expressed as Spark jobs."""

__all__ = ["session", "schemas"]
