"""Run monitors on Structured Streaming."""
