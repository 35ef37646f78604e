"""Column functions: expressions that stay inside Spark's code generation, and the few Arrow UDFs that can't."""
