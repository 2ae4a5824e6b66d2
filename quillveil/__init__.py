"""Sensitive-entity detection, redaction and corpus operators as Spark DataFrame transformations."""
