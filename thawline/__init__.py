"""thawline: microclimate analytics as Spark jobs."""
