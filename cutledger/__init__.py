"""Table and stream operators for telemetry, sales, billing, cutting jobs and flat geometry, on Spark."""
