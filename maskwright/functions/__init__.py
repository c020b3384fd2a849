"""Column functions: text normalisers, validators and extractors."""
