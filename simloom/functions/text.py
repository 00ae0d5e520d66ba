"""Keys, paths and task texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_KEY = r"^ep(\d+)_fr(\d+)$"


def episode_of(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, FRAME_KEY, 1), F.lit("")).cast("long")


def frame_of(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, FRAME_KEY, 2), F.lit("")).cast("long")


def member_key(name: Column) -> Column:
    """What stands before the first dot of a tar member's name."""
    return F.substring_index(name, ".", 1)


def path_part(path: Column, after: str, k: int) -> Column:
    """The ``k``-th component of ``path`` after the component ``after`` (1 is the next), or null."""
    parts = F.split(path, "/")
    at = F.array_position(parts, after).cast("int")
    return F.when((at > 0) & (F.size(parts) >= at + k), F.element_at(parts, at + k))


def dataset_of(path: Column, marks: dict[str, str], other: str) -> Column:
    """The data set of the first of ``marks`` that stands anywhere in ``path``, else ``other``."""
    return F.coalesce(*(F.when(F.contains(path, F.lit(mark)), name) for mark, name in marks.items()), F.lit(other))


def safe_name(path: Column) -> Column:
    """A cache file's name: the scheme goes, slashes become underscores."""
    return F.translate(F.regexp_replace(path, r"^[a-z0-9]+://", ""), "/", "_")


def truncated(text: Column, size: int, mark: str = "…") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(mark))).otherwise(text)


def wrapped(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, filled word by word; a longer word is a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(s, w):
        fits = (s["line"] == "") | (F.length(s["line"]) + 1 + F.length(w) <= width)
        longer = F.when(s["line"] == "", w).otherwise(F.concat(s["line"], F.lit(" "), w))
        return F.when(fits, F.struct(s["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(F.concat(s["done"], F.array(s["line"])).alias("done"), w.alias("line")))

    return F.aggregate(words, start, add, lambda s: F.when(s["line"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["line"]))))
