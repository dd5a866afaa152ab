"""Scheduled refresh as Structured Streaming."""
