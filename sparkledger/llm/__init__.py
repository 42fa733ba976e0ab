"""Operators for training corpora: language, near copies, repeats, leaks, mixing, toxicity, tokens, URLs, licences, vectors."""
