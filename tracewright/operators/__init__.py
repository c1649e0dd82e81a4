"""Operators on rollout tables: DataFrame in, DataFrame out, lazy."""
