"""Operators that large training-data pipelines need, as Spark jobs over whole tables."""
