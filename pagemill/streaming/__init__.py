"""Structured Streaming variants of the scans."""
