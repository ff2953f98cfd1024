"""Spark jobs that ask whether labelled sets of positions agree more than chance."""
