"""Training-data operators: quality, tokenizers, near duplicates, decontamination, extraction."""
