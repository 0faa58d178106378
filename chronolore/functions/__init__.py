"""Scalar functions: columns in, a column out. All run inside the JVM."""
