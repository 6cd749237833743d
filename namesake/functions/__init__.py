"""Column functions: text cleaning, names, phonetic keys."""
