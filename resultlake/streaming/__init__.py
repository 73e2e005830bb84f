"""Structured Streaming: ledgers with deduplication, cool-downs as keyed state, windows."""
