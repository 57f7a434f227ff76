"""Set reconciliation, revision diff and corpus preparation on Spark DataFrames."""
