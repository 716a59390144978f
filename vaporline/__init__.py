"""Vaporline: a Spark-native batch analytics engine for long-format telemetry."""
