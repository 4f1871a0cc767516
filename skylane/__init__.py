"""Skylane: a PySpark-native analytics library for urban mobility and weather data."""
