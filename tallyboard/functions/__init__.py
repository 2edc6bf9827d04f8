"""Column builders. All of them stay in the JVM; none is a UDF."""
