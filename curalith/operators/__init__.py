"""Table operators. Each is ``fn(df, ...) -> DataFrame``: lazy, without driver loops over rows."""
