"""Structured Streaming forms: windowed latencies, deduplicated deliveries, search-field upkeep."""
