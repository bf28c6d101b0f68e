"""Structured Streaming operators over run events, calls and arriving runs."""
