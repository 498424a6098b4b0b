"""Operators over Structured Streaming inputs."""
