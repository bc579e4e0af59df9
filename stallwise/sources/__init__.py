"""Readers, scans and writers."""
