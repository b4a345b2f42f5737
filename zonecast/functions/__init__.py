"""Column-level functions: pure ``Column -> Column`` builders, all JVM built-ins."""
