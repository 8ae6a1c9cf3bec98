"""Structured Streaming: ticks into a store, and liveness as state."""
