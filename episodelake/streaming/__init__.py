"""Streaming of the episode engine."""
