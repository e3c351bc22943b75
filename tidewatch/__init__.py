"""Market-surveillance analytics as composable Spark transforms."""
