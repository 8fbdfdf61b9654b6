"""Metric measure spaces on Spark: sampled tuples, their invariants, and what they guarantee."""
