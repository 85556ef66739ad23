"""Operators of a training-data pipeline; see the README for what each one does."""
