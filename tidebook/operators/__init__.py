"""Operators over level rows: books, snapshots, segments, placement."""
