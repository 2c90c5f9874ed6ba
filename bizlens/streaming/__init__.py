"""Structured Streaming twins of the scheduled and live computations."""
