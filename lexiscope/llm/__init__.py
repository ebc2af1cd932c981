"""Training-data operators: language ID, exact search, toxicity, HTML extraction, sharding,
mixing, decontamination, secret scans, token counts and near-duplicate removal.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
