"""Column-expression helpers shared by the operators (all JVM-side except
the p-value functions, which run on result rows only)."""
