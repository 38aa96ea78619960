"""Column-expression library (all native Spark functions, no Python UDFs)."""
