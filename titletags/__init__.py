"""Sequence-labelling data jobs for product titles, as Spark DataFrame operators."""
