"""Colloquy: plans."""
