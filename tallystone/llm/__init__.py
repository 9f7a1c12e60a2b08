"""Training-data operators: dedup, mixing, language ID, search, decontamination, scoring, encoding, fixity.

Nothing else in the library imports this subpackage, so it can be removed as a whole.
"""
