"""Operators over one corpus of texts, and training-data operators in `llm`."""
