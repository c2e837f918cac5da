"""Table jobs of the write path: validation, folds, dedup and resolution state."""
