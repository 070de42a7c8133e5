"""Whole flows built from the operators: training, explanation, report."""
