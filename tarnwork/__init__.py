"""Tarnwork: text compaction and code/context retrieval on PySpark."""
