"""Structured Streaming jobs: counters, retention, cooldown, feedback and event-time windows."""
