"""Price-panel analytics on Spark: long-format DataFrame operators, no driver-side data."""
