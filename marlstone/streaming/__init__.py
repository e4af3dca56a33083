"""Structured Streaming into series; an extension."""
