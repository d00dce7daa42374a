"""Redaction of sensitive data and layout masking as DataFrame operations."""
