"""Column functions: no joins, no shuffles, usable in batch and in streams."""
