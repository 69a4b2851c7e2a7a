"""orograph: terrain, viewpoint and log analytics as Spark plans."""
