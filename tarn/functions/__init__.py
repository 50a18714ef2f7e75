"""Column functions over strings and arrays; all of them stay in the JVM."""
