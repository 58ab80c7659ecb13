"""Operators of a training-data pipeline: survivorship, incremental dedup, subset choice, neighbours,
clusters, mergeable percentiles, packing, leakage search and personal-data masking."""
