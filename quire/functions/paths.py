"""Ids, names and titles from paths, and checks of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schemas import BROWSER_SCHEME, UNTITLED

# Offset basis and prime of the 32-bit FNV-1a hash, and white space besides what \s matches.
FNV_BASIS, FNV_PRIME, MASK_32 = 2166136261, 16777619, 0xFFFFFFFF
_SPACE = r"[\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def trim_space(text: Column) -> Column:
    """text without white space, of any script, at its ends."""
    return F.regexp_replace(text, rf"\A{_SPACE}|{_SPACE}\z", "")


def document_id(path: Column) -> Column:
    """doc_ and eight hexadecimal digits: FNV-1a over the UTF-16 code units of a path."""
    units = F.hex(F.encode(path, "UTF-16BE"))
    count = (F.length(units) / 4).cast("int")
    codes = F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(units, (i - 1) * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    start = F.lit(FNV_BASIS).cast("bigint")
    hashed = F.when(count == 0, start).otherwise(F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(MASK_32))))
    return F.concat(F.lit("doc_"), F.lpad(F.lower(F.hex(hashed)), 8, "0"))


def file_name(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.coalesce(F.nullif(F.element_at(F.split(path, r"[\\/]"), -1), F.lit("")), F.lit(UNTITLED))


def title_or(title: Column, fallback: Column, ending: str = "pdf") -> Column:
    """The trimmed title, or else fallback without its ending."""
    return F.coalesce(F.nullif(trim_space(title), F.lit("")), F.regexp_replace(fallback, rf"(?i)\.{ending}\z", ""))


def is_browser_path(path: Column) -> Column:
    return F.startswith(path, F.lit(BROWSER_SCHEME))


def browser_path(name: Column) -> Column:
    return F.concat(F.lit(BROWSER_SCHEME), name)


def has_pdf_ending(path: Column) -> Column:
    """Whether a path names a file with the ending; a name of the ending alone has none."""
    return path.rlike(r"(?i)[^/\\]\.pdf\z")


def path_error(path: Column, exists: Column, is_file: Column) -> Column:
    """The first check that a path fails, in this order, else null."""
    return F.when(~has_pdf_ending(path), "not a pdf").when(~exists, "not found").when(~is_file, "not a file")


def browser_accepts(mime: Column, name: Column) -> Column:
    """A file dropped into a browser counts by its type or its name."""
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.endswith(F.lower(name), F.lit(".pdf"))
