"""Colloquy: functions."""
