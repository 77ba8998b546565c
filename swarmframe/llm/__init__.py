"""Operators for preparing training data: packing, duplicates, mixing, language, tokens, neighbours, toxicity, pages."""
