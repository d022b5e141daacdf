"""Thornwall: scanning text tables and repositories for prompt-injection payloads with Spark."""

__version__ = "0.1.0"
