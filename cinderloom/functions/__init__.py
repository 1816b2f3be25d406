"""Column functions: parsing of replies and names, intervals and frames, token arrays."""
