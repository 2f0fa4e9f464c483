"""Structured Streaming delivery."""
