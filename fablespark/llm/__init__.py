"""Operators that prepare training text: grouping, splitting, sentences, names, survivors, packing, mixing, personal data."""
