"""Analytics for team-sport competitions as Spark DataFrame jobs."""
