"""Training-data operators: language id, rendering, search, scoring, dedup, decontamination, sharding, fixity, tokens.

Nothing outside this subpackage imports it; `queries` and `oracles` here are picked up by the entry module when present.
"""
