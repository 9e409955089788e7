"""Page-text jobs on Spark: nodes, facts, views, logs, policy and redaction as DataFrames."""
