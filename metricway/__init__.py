"""Governed metrics, change analysis and call evidence as Spark jobs."""
