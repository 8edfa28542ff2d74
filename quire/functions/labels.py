"""Texts shown to the reader and read from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.normalize import percent
from quire.functions.paths import trim_space

# Labels as shown.
READY, SYNCED, APART = "준비됨", "동기화됨", "독립 보기"
MODES = {"single": "원문", "side-by-side": "좌우 분할"}
OTHER_MODE = "상하 분할"
NO_MATCH, NO_DOCUMENT = "일치하는 논문이 없습니다.", "아직 연 논문이 없습니다."


def number_text(value: Column) -> Column:
    """A number as a script prints it: whole ones without a point, an exponent only below a millionth and from 1e21 on."""
    value = value.cast("double")
    sign, size, text = F.when(value < 0, "-").otherwise(""), F.abs(value), F.abs(value).cast("string")
    mantissa, exponent = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", ""), F.substring_index(text, "E", -1).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    scientific = F.concat(mantissa, F.when(exponent < 0, "e").otherwise("e+"), exponent.cast("string"))
    small = F.concat(F.lit("0."), F.lpad(digits, F.length(digits) - exponent - 1, F.lit("0")))
    whole = F.rpad(digits, F.greatest(F.length(digits), exponent + 1), F.lit("0"))
    large = F.concat(F.substr(whole, F.lit(1), exponent + 1), F.when(F.length(whole) > exponent + 1, F.concat(F.lit("."), F.substr(whole, exponent + 2))).otherwise(""))
    moved = F.when((size < 1e-6) | (size >= 1e21), scientific).when(exponent < 0, small).otherwise(large)
    return F.concat(sign, F.when(text.contains("E"), moved).otherwise(F.regexp_replace(text, r"\.0$", "")))


def preset_or_number(preset: Column, scale: Column) -> Column:
    return F.coalesce(F.nullif(preset, F.lit("")), number_text(scale))


def status_label(has_document: Column, split_mode: Column, sync_enabled: Column) -> Column:
    mode = F.when(split_mode == "single", MODES["single"]).when(split_mode == "side-by-side", MODES["side-by-side"]).otherwise(OTHER_MODE)
    sync = F.when(sync_enabled, SYNCED).otherwise(APART)
    return F.when(has_document, F.concat(mode, F.lit(" · "), sync)).otherwise(READY)


def position_label(page: Column, scale: Column, rotation: Column) -> Column:
    return F.concat(F.lit("p. "), page.cast("string"), F.lit(" · "), percent(scale).cast("string"), F.lit("% · "), rotation.cast("string"), F.lit("°"))


def empty_label(rows: Column, query: Column) -> Column:
    """What an empty list says; a query of white space counts as one."""
    return F.when(rows == 0, F.when(F.length(query) > 0, NO_MATCH).otherwise(NO_DOCUMENT))


def recent_label(opened: Column, now: Column) -> Column:
    """Time of day if opened on the day of now, else month and day, in Korean."""
    timed = lambda layout: F.to_csv(F.struct(opened.cast("timestamp").alias("t")), {"locale": "ko-KR", "timestampFormat": layout, "quote": "\u0000"})
    return F.when(F.to_date(opened) == F.to_date(now), timed("a hh:mm")).otherwise(timed("M월 d일"))


def page_input(text: Column) -> Column:
    """The number that a page box is read as: empty is 0, what is no finite number is null."""
    plain = trim_space(text)
    based = F.when(plain.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substring(plain, 3, 99), 16, 10)).when(plain.rlike("^0[oO][0-7]+$"), F.conv(F.substring(plain, 3, 99), 8, 10))
    based = based.when(plain.rlike("^0[bB][01]+$"), F.conv(F.substring(plain, 3, 99), 2, 10))
    plain_number = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    number = F.when(plain == "", 0.0).otherwise(F.coalesce(based.try_cast("double"), plain_number))
    return F.when(F.abs(number) < float("inf"), number)
