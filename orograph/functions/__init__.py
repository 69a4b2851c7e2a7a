"""orograph.functions."""
