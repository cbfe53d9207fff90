"""Operators of a training-data pipeline: URL rules, quality, mixing, near-duplicates,
tokenisation, sharding, decontamination, boilerplate lines, ranked search, spelling variants and
language identification.

Nothing outside this subpackage imports it.
"""
