"""Operators for training-data pipelines: dedup, language, toxicity, extraction, search, mixing, tokens, chat."""
