"""Which controls are off, which row is active, and which updates count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def previous_off(has_document: Column, page: Column) -> Column:
    return ~has_document | (page <= 1)


def next_off(has_document: Column, page: Column, page_count: Column) -> Column:
    return ~has_document | (page >= page_count)


def sync_off(has_document: Column, split_mode: Column) -> Column:
    """One pane has nothing to be in sync with."""
    return ~has_document | (split_mode == "single")


def is_active(row_id: Column, active_id: Column) -> Column:
    return F.coalesce(row_id == active_id, F.lit(False))


def is_ready(viewer_ready: Column, page_height: Column) -> Column:
    """Whether a position can be applied or read: the viewer is there and so is the page."""
    return F.coalesce(viewer_ready, F.lit(False)) & page_height.isNotNull()
