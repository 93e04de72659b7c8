"""The named queries, by subject."""
