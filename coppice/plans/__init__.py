"""Whole studies assembled from the operators: table building, fitting, explaining, tuning."""
