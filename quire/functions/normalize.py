"""Arithmetic of views: clamping, rounding half up, anchors, rotations, zoom steps, merges of sparse updates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import CLOSE, LEAST_SCALE, MOST_SCALE, SCALE_STEP, SCROLL_PX


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(value: Column, least, most) -> Column:
    """value kept between least and most; null and NaN stay what they are."""
    inside = F.least(F.greatest(value, _col(least)), _col(most))
    return F.when(value.isNull() | F.isnan(value.cast("double")), value).otherwise(inside)


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(value.cast("double") + 0.5)


def normalize_page(page: Column, page_count: Column) -> Column:
    return round_half_up(clamp(page.cast("double"), 1.0, F.greatest(page_count, F.lit(1)).cast("double"))).cast("int")


def normalize_offset(offset: Column) -> Column:
    return clamp(offset.cast("double"), 0.0, 1.0)


def normalize_rotation(rotation: Column) -> Column:
    """Nearest quarter turn, from 0 to 270."""
    return F.pmod(round_half_up(rotation.cast("double") / 90) * 90, F.lit(360)).cast("int")


def normalize_scale(scale: Column) -> Column:
    return clamp(scale.cast("double"), LEAST_SCALE, MOST_SCALE)


def scale_by(scale: Column, zoom_in: Column) -> Column:
    """One zoom step in or out."""
    return normalize_scale(scale * F.when(zoom_in, F.lit(SCALE_STEP)).otherwise(F.lit(1.0 / SCALE_STEP)))


def percent(scale: Column) -> Column:
    return round_half_up(scale * 100).cast("bigint")


def merge_view(current: Column, update: dict[str, Column], page_count: Column) -> Column:
    """The view after a sparse update: fields that are null in it stay, all are normalized."""
    pick = lambda name: F.coalesce(update[name].cast("double"), current[name].cast("double")) if name in update else current[name].cast("double")
    return F.struct(
        normalize_page(pick("page_number"), page_count).alias("page_number"),
        normalize_offset(pick("relative_offset_y")).alias("relative_offset_y"),
        (F.coalesce(update["scale_value"], current["scale_value"]) if "scale_value" in update else current["scale_value"]).alias("scale_value"),
        normalize_scale(pick("scale")).alias("scale"),
        normalize_rotation(pick("rotation")).alias("rotation"),
    )


def view_is_close(left: Column, right: Column) -> Column:
    """Whether two views are alike to the eye."""
    same = [left[c].eqNullSafe(right[c]) for c in ("page_number", "scale_value", "rotation")]
    near = [F.abs(left[c] - right[c]) < CLOSE for c in ("relative_offset_y", "scale")]
    return same[0] & same[1] & same[2] & near[0] & near[1]


def scroll_to_anchor(scroll_top: Column, page_top: Column, page_height: Column) -> Column:
    """How far down its page a scroll position is, from 0 to 1."""
    return clamp((scroll_top - page_top) / F.greatest(page_height, F.lit(1.0)), 0.0, 1.0)


def anchor_to_scroll(offset: Column, page_top: Column, page_height: Column) -> Column:
    return page_top + normalize_offset(offset) * F.greatest(page_height, F.lit(1.0))


def applied_scroll(current: Column, target: Column, tolerance: float = SCROLL_PX) -> Column:
    """Where a view is scrolled to: the target, unless the view is as near to it as the tolerance."""
    return F.when(F.abs(current - target) > tolerance, target).otherwise(current)
