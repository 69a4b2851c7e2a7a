"""orograph.operators."""
