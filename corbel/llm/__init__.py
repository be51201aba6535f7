"""Training-data operators: near-duplicates, language, search, decontamination, quality, language models, archives, mixing, token files."""
