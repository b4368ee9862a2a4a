"""Column functions: arrays, text and aggregates. All stay in the JVM."""
