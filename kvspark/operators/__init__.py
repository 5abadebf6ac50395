"""Operators on the model's DataFrames."""
