"""Platform contamination-risk analytics as Spark jobs."""
