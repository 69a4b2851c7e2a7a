"""orograph.sources."""
