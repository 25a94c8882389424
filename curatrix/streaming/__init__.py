"""Structured Streaming forms of append-only files, resumed jobs and rolling summaries."""
