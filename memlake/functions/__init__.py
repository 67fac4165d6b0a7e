"""Column expressions: pure functions of columns, evaluated on the JVM."""
