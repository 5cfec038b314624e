"""Sources of the episode engine."""
