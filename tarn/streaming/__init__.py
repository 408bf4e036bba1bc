"""Structured Streaming counterparts of continuous ingest, call rings and rate limits."""
