"""Colloquy: llm."""
