"""Column-level helpers; all of them build expressions that stay on the JVM."""
