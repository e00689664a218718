"""Structured Streaming over answers, usage and sessions."""
