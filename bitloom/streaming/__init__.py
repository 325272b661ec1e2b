"""Chunk statistics over streams."""
