"""PySpark-native analytics for web pages and browser telemetry."""
