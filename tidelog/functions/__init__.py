"""Column helpers of the change feed."""
