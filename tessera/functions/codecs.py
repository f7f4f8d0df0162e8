"""Identifiers and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def docid(id_: Column) -> Column:
    """Lower-case hex of at least six digits."""
    h = F.lower(F.hex(id_))
    return F.when(F.length(h) < 6, F.lpad(h, 6, "0")).otherwise(h)


def docid_value(text: Column) -> Column:
    """The id of a docid; null unless all of it is hex."""
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{1,15}\z"), F.conv(text, 16, 10).cast("long"))


def safe_name(text: Column) -> Column:
    """Unpadded URL-safe base64, fit for a file name; its first two letters are a shard."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"\s", ""), "+/=", "-_ "))


def safe_value(name: Column) -> Column:
    """The text that a safe name stands for; null unless it is one."""
    padded = F.rpad(name, (F.floor((F.length(name) + 3) / 4) * 4).cast("int"), "=")
    return F.when(name.rlike(r"\A[A-Za-z0-9_-]*\z"), F.decode(F.unbase64(F.translate(padded, "-_", "+/")), "UTF-8"))


def cache_key(kind: str, model: str, query: Column, documents: Column | None = None) -> Column:
    parts = [F.lit(kind), F.lit(model), query]
    return F.concat_ws(":", *parts, *([F.sha1(F.array_join(documents, "\u0001"))] if documents is not None else []))


def relative_path(path: Column, root: Column) -> Column:
    """The path below a root; unchanged outside it."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)
