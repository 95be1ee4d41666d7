"""Training-data operators: mixing, token counts, quality, PII, language, dedup, decontamination, search."""
