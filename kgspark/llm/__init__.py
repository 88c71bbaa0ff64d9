"""Operators for training-data pipelines; nothing else in kgspark imports this subpackage."""
