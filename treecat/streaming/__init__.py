"""Streams: level tables that grow as parts arrive."""
