"""Operators: DataFrame in, DataFrame with a fixed schema out."""
