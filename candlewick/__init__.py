"""A PySpark engine that screens large universes of ordered bar series."""
