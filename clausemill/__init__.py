"""Document analytics on Spark: text profiling, structure, chunks, clauses, claims, vectors."""
