"""Structured Streaming: standing subscriptions and the live book."""
