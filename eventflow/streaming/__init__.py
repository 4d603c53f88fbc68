"""Structured Streaming forms of operators that keep their own state, and ways to run them."""
