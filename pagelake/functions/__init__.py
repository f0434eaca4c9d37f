"""Column -> Column building blocks; all are JVM expressions."""
