"""A PySpark engine for recorded episodes, their statistics and their prompts."""
