"""Operators on memories, their texts, their vectors and their graph."""
