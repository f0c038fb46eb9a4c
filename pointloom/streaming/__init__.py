"""Frames that arrive as a stream."""
