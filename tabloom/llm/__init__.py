"""Training-data operators: quality, URLs, licenses, scoring, duplicates, decontamination, mixing, sharding, secrets."""
