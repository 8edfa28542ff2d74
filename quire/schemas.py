"""Schemas of the data model and the defaults of a view."""

from __future__ import annotations

from pyspark.sql import types as T



def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_TEXT, _INT, _LONG, _REAL, _FLAG, _TIME = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

VIEW_STATE = _struct(page_number=_INT, relative_offset_y=_REAL, scale_value=_TEXT, scale=_REAL, rotation=_INT)

LIBRARY = _struct(
    id=_TEXT, file_path=_TEXT, title=_TEXT, page_count=_INT, last_opened_at=_TIME, page_number=_INT, relative_offset_y=_REAL, scale_value=_TEXT, scale=_REAL,
    rotation=_INT, split_mode=_TEXT, sync_enabled=_FLAG, updated_at=_TIME,
)

READER_DOCUMENT = _struct(id=_TEXT, file_path=_TEXT, title=_TEXT, page_count=_INT, last_opened_at=_TIME, view_state=VIEW_STATE, split_mode=_TEXT, sync_enabled=_FLAG)

#: An update of a view. Null means that a field is absent. page_number and rotation are rounded on merge.
PANE_EVENT = _struct(
    event_id=_LONG, ts=_TIME, doc_id=_TEXT, pane_id=_TEXT, kind=_TEXT, page_number=_REAL, relative_offset_y=_REAL, scale_value=_TEXT, scale=_REAL, rotation=_REAL,
)

# Fixed values of the data model.
DEFAULT_VIEW = {"page_number": 1, "relative_offset_y": 0.0, "scale_value": "page-width", "scale": 1.0, "rotation": 0}
DEFAULT_SPLIT, DEFAULT_SYNC = "side-by-side", True
SPLIT_MODES = ("single", "side-by-side", "stacked")
LEAST_SCALE, MOST_SCALE, SCALE_STEP = 0.25, 4.0, 1.1
CLOSE = 0.002
RECENT = 20
DEBOUNCE_MS, ECHO_MS, SCROLL_PX = 450, 80, 3
BROWSER_SCHEME = "browser://"
UNTITLED = "Untitled.pdf"
