"""Colloquy: operators."""
