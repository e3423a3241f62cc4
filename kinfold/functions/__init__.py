"""Column-level functions: text, fuzzy scores, normalisers."""
