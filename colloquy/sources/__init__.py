"""Colloquy: sources."""
