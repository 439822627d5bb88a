"""Readers of labelled streams."""
