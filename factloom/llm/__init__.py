"""Training-data operators: scans, scoring, deduplication, mixing, packing and formatting of text at scale."""
