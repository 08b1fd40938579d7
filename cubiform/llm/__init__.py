"""Training-data operators.

Ten corpus operators (URL filters, secret scans, source mixing, substring dedup,
decontamination, near-dedup, quality rules, suffix-array dedup, toxicity, PII) that stand
apart from the exact-scene engine: nothing else in the package imports this folder.
"""
