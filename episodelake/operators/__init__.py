"""Operators of the episode engine."""
