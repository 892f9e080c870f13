"""Operators for preparing training text: search, sharding, near duplicates, tokens, personal data,
mixing, chat layouts, page text, fingerprints and toxicity. Nothing else in the library imports this."""
