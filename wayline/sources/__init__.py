"""Readers and derived relations."""
