"""Operators for training text: residue, languages, packing, leaks and splitting."""
