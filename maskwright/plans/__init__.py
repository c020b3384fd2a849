"""Assembled queries and their SQL counterparts."""
