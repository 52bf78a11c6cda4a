"""User-level operators of the rates pipeline."""
