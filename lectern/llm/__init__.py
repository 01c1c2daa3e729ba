"""Training-data operators: search, packing, mixing, dedup, filters, language ID, PII, counts, sharding.

Nothing outside this package imports it; the driver contract adds its queries only if it is present.
"""
