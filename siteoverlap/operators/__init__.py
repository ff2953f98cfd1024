"""Transformations of site tables: DataFrame in, DataFrame out."""
