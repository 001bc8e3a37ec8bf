"""Readers of landed marketplace payloads: rows out, rejects counted, nothing fetched."""
