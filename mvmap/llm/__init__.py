"""Operators that prepare training text: packing, sharding, line and document
de-duplication, toxicity and quality models, licence scans, quality rules,
benchmark decontamination and token-id files.

Nothing outside this subpackage imports it.
"""
