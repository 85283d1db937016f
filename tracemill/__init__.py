"""Reasoning-trace analytics as DataFrame operators."""
