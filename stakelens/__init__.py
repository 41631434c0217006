"""Player-event analytics for an online gaming operator, as Spark jobs."""
