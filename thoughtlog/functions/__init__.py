"""Column functions: plain expressions that stay inside the JVM."""
