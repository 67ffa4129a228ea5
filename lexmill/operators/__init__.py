"""Relational operators: quotas, packing, dedup and decontamination, splits and mixing, benchmarks, perplexity, logs."""
