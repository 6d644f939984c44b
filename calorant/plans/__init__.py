"""Plans built of operators: mart, product queries, publication, loading, and the registered queries."""
