"""Training-data operators: near-duplicate search, extraction, mixing, scoring and the like."""
