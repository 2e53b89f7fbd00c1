"""The SQL dialect: tokens, the rewriting into Spark SQL, and the engine that runs statements."""
