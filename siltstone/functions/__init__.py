"""Column functions: text, numbers, JSON. All run in the JVM."""
