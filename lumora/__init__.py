"""A Spark-first analytics engine: relational operators over Parquet and SQLite, and a strict SQL dialect."""
