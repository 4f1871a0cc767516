"""Streams: wire format, sinks, query groups."""
