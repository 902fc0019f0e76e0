"""Operators of a training-data pipeline: filter, deduplicate, decontaminate, mix, shard."""
