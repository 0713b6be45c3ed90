"""The query catalogue and its bindings to concrete tables."""
