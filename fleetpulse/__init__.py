"""fleetpulse: app-performance telemetry analytics expressed as Spark DataFrame operators."""
