"""Scalar functions on text, times and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds that may be read.
VIDEO_KINDS = ("mp4", "avi", "mkv", "mov", "wmv", "flv", "m4v")
SUBTITLE_KINDS = ("srt", "ass", "ssa", "vtt")


def clean_text(text: Column) -> Column:
    """Line ends become blanks, outer white space goes."""
    return F.regexp_replace(F.regexp_replace(text, "\n", " "), r"^\s+|\s+$", "")


def clock(seconds: Column) -> Column:
    """Minutes, unbounded, and seconds with two decimals."""
    return F.format_string("%02d:%05.2f", F.floor(seconds / 60).cast("int"), seconds % 60)


def minutes(seconds: Column) -> Column:
    """m:ss, fractions cut off."""
    return F.format_string("%d:%02d", F.floor(seconds / 60).cast("int"), F.floor(seconds % 60).cast("int"))


def minutes_exact(seconds: Column) -> Column:
    """m:ss.ss"""
    return F.format_string("%d:%05.2f", F.floor(seconds / 60).cast("int"), seconds % 60)


# Colours of speakers, by number.
COLOURS = 8


def colour(number: Column) -> Column:
    return F.pmod(number, F.lit(COLOURS))


def title(label: Column) -> Column:
    """The first underscore becomes a blank, all letters capitals."""
    return F.upper(F.regexp_replace(label, r"^([^_]*)_", "$1 "))


def safe_name(name: Column) -> Column:
    """Letters, digits and `._-` of a file name."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "")


def has_kind(name: Column, kinds: tuple[str, ...]) -> Column:
    return name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*kinds)


def preview(text: Column, most: int = 50) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def timecode(text: Column) -> Column:
    """Seconds of an `hh:mm:ss,mmm` time code."""
    part = lambda i: F.regexp_extract(text, r"(\d+):(\d+):(\d+)[,.](\d+)", i).cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def bounded(w: Column, h: Column, most_w: int, most_h: int) -> tuple[Column, Column]:
    """Width and height scaled down to fit, never up, fractions cut off."""
    scale = F.least(F.lit(1.0), most_w / w, most_h / h)
    return F.floor(w * scale).cast("long"), F.floor(h * scale).cast("long")


def padded(start: Column, end: Column, before: float = 0.1, more: float = 0.2) -> tuple[Column, Column]:
    """Start and duration of an interval with a margin; the start stays at 0 or more."""
    return F.greatest(F.lit(0.0), start - before), end - start + more


def progress(step: Column, total: int) -> tuple[Column, Column]:
    """Whole percent and the place (0 to 6) of the stage that it falls in."""
    percent = F.floor(step * 100 / total)
    place = F.lit(0)
    for bound in (15, 30, 45, 60, 75, 90):
        place = place + (percent >= bound).cast("int")
    return percent, place


def parsed_size(text: Column) -> tuple[Column, Column]:
    """Width and height of `WxH`; null where a part is no whole number."""
    parts = F.split(text, "x")
    return F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
