"""Subscriptions and projections on Structured Streaming."""
