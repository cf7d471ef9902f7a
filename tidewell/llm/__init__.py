"""Training-data operators: tokenising, quality, licences, media, PII, near and exact duplicates, language models, mixing."""
