"""Relational and learning operators: DataFrame in, DataFrame out."""
