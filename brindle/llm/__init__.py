"""Training-data operators: dedup, token counts, extraction, mixing, scans and quality rules."""
