"""Training-data operators: sharding, tokens, near copies, language, personal data, quality, mixing, search and archives."""
