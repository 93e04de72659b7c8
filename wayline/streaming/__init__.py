"""Stateful streams and their batch twins."""
