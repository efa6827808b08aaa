"""Sensitive-data discovery on Spark: detect, resolve, label, store, review and evaluate."""
