"""Operators for large text corpora: encoding, fingerprints, deduplication, scans, scoring and packing.

Nothing else in the library imports this subpackage.
"""
