"""Reading JSON that isn't quite: fences, trailing commas, missing ends, tables and lists in plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body(text: Column) -> Column:
    """The part within a code fence, else from the first opening to the last closing bracket; no trailing commas."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    widest = F.nullif(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1), F.lit(""))
    return F.regexp_replace(F.coalesce(fenced, widest, text), r",\s*([\]}])", "$1")


def close_brackets(text: Column) -> Column:
    """A list of flat objects that breaks off: the unfinished object is dropped and the list closed."""
    return F.when(F.rtrim(text).endswith("]"), text).otherwise(F.concat(F.regexp_replace(text, r"(?s)(\}|\[)[^\}]*$", "$1"), F.lit("]")))


def table_cells(text: Column) -> Column:
    """Cells of the body rows of a pipe table: rules and the head row are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s|:-]+\|?$"))
    rows = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c)))


def listed(text: Column, wrapper: str, item: str) -> Column:
    """The list of ``item``s in a reply, whether it stands alone or under the key ``wrapper``; null without either."""
    inner = body(text)
    return F.coalesce(F.from_json(inner, f"struct<{wrapper}: array<{item}>>")[wrapper], F.from_json(inner, f"array<{item}>"))
