"""Streams: sections of an analysis kept up to date while files change."""
