"""Colloquy: conversation and context analytics as composable PySpark DataFrame operators."""
