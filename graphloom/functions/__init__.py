"""Column functions: names, paths, languages, tokens."""
