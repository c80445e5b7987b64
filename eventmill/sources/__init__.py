"""Readers of page archives, fetch logs, API payloads and published documents."""
