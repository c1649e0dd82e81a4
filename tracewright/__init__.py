"""Spark operators for rollout analytics of language-model reasoning."""
