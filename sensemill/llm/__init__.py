"""Training-data operators: quality, language modelling, duplication, leakage, secrets, mixing, archives, vectors."""
