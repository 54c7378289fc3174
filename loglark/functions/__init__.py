"""Column functions: parsing of one line, query strings, hashing."""
