"""Structured Streaming: the batch apply functions over a stream."""
