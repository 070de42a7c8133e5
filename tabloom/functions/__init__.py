"""Column expressions: everything here maps columns to columns, inside the JVM."""
