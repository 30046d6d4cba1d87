"""Operators for preparing training data at scale: language-model scoring,
decontamination, tokenization, near-duplicate joins, archives, license scans,
substring removal and quality classification.

Nothing else in the library imports this subpackage.
"""
