"""orograph.plans."""
