"""Spark-first generalized linear models and training-text preparation."""
