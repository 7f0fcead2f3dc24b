"""Corpus operators for building language-model training data on Spark."""
