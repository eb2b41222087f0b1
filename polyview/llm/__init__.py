"""Operators for training-data pipelines over web text, each a function from DataFrame to DataFrame."""
