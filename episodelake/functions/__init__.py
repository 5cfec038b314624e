"""Functions of the episode engine."""
