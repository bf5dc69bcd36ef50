"""Column functions: everything here runs inside the JVM, without Python workers."""
