"""Spark-native analytics for irregular telemetry, events, orbits and radio observations."""
