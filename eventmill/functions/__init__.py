"""Column expressions of the event tables. Each takes and returns columns and runs inside the JVM."""
