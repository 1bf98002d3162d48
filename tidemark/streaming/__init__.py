"""Structured Streaming: tailing, micro-batches and stateful operators."""
