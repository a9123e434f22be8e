"""Operators over points (topic, t, v): t is epoch milliseconds, v a double."""
