"""Requirement-to-code traceability as Spark DataFrame operators."""
