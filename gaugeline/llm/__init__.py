"""Operators on text corpora: archives, filters, near duplicates, decontamination, personal data, token output."""
