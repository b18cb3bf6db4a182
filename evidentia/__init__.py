"""Identity-document analytics on Spark: DataFrame operators, column functions and plans."""
