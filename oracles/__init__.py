"""Independent DuckDB SQL formulations of the registered queries (correctness gate)."""
