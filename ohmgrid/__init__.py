"""ohmgrid: a PySpark-native analytics engine for instrument measurement data."""
