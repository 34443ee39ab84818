"""Operators for preparing text corpora: mixing, sharding, deduplication, tokens, licences, quality, toxicity, addresses.

Nothing else in the package imports this one; it may use the general helpers of the package.
"""
