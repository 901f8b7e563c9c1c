"""Colloquy: streaming."""
