"""Operators over captures, summaries, token usage and frames."""
