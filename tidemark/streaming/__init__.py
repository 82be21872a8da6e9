"""Structured Streaming forms of the polling, heartbeat and snapshot flows."""
