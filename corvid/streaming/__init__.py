"""Structured Streaming: metric logs followed as they grow."""
