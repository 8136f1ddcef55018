"""Field-telemetry analytics as Spark DataFrame operators."""
