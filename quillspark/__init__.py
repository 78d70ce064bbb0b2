"""Search-and-rank analytics written for Spark: every operator is a DataFrame plan."""
