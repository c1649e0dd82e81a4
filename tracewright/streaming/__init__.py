"""Stateful and event-time operators."""
