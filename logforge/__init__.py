"""Spark jobs that turn wide, sparse event logs into trustworthy machine-learning tables and evaluate what is built on them."""
