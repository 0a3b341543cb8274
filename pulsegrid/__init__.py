"""Traffic-telemetry analytics on Spark."""
