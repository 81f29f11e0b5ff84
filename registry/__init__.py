"""The registered queries: each key has a Spark query and, where SQL can say it, a check."""
