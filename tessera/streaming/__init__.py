"""Streaming: change events, debounced and applied."""
