"""mnemospark: DataFrame and SQL operators for agent-memory data on PySpark."""
