"""Operators over ordered streams, as windows, joins and folds."""
