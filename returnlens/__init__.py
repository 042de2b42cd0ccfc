"""Return, campaign and replenishment analytics as Spark DataFrame functions."""
