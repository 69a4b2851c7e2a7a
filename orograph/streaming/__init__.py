"""orograph.streaming."""
