"""Column functions; none of them shuffles or leaves the JVM."""
