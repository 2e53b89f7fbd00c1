"""quernlake: SQL analytics on Spark, with versioned tables, time travel and a compact dialect."""
