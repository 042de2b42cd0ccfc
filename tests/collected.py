"""Rows of a frame in a fixed order."""

from __future__ import annotations


def rows(frame, *columns):
    """All rows as sorted tuples."""
    frame = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
