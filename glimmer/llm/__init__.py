"""Training-data operators: formatting, tokenising, scoring, filtering, near-duplicate search and packing."""
