"""Training-data operators: deduplication, search, privacy, language, tokens and licences."""
