"""tessera: analytics, text, vector and streaming operators as plain Spark DataFrame plans."""
