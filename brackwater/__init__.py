"""Brackwater: a Spark-first analytics engine for public-safety signals."""
