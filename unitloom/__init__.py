"""Unitloom: Spark-first document analytics, from raw documents to ordered, audited text units."""
