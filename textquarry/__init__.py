"""Corpus preparation and tokenizer analytics on Spark."""
