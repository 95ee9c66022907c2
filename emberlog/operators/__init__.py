"""Operators: DataFrame in, DataFrame out. ``logs`` has ts, labels, msg and usually capture, file."""
