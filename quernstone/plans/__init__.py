"""Sessions, checkpoints and whole pipelines."""
