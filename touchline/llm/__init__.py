"""Operators for training-data corpora: archives, deduplication, decontamination, secrets, tokens, toxicity and quality."""
