"""Sports tracking, evidence and retrieval analytics on PySpark."""
