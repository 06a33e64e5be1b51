"""Token, prefix and label expressions; all native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelet.schema import END, START


def tokenize(text: Column) -> Column:
    """Split at runs of Unicode white space; empty or null gives no tokens; reserved tokens are escaped by a backslash."""
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " ")), " ")
    return reserved_escaped(F.filter(parts, lambda t: t != ""))


def reserved_escaped(tokens: Column) -> Column:
    """A data token that reads like a padding token gets a backslash, so it can't cut a sequence short."""
    return F.transform(tokens, lambda t: F.when(t.isin(START, END), F.concat(F.lit("\\"), t)).otherwise(t))


def padded(tokens: Column, order: int) -> Column:
    """``order`` start tokens, the tokens, one end token."""
    return F.concat(F.array_repeat(F.lit(START), order), tokens, F.array(F.lit(END)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` refers to it, also inside functions over arrays."""
    return F.element_at(F.transform(F.array(value), then), 1)


def steps(tokens: Column, order: int) -> Column:
    """Array of (pos, prefix, token) for every step of a sequence, the step to the end included."""

    def of(s: Column) -> Column:
        at = F.sequence(F.lit(order), F.size(s) - 1)
        return F.transform(at, lambda i: F.struct((i - order).cast("int").alias("pos"), F.array_join(F.slice(s, i - order + 1, order), " ").alias("prefix"), F.element_at(s, (i + 1).cast("int")).alias("token")))

    return let(padded(tokens, order), of)


def start_prefix(order: int) -> str:
    return " ".join([START] * order)


def next_prefix(prefix: Column, token: Column, order: int) -> Column:
    """Drop the first token of the prefix and append the next one; null behind the end token."""
    moved = token if order <= 1 else F.concat(F.substring_index(prefix, " ", -(order - 1)), F.lit(" "), token)
    return F.when(token != END, moved)


def seed_prefix(seed: Column, order: int) -> Column:
    """The prefix that a seed selects: its last tokens, padded at the left; a blank or null seed selects the start."""
    tokens = F.concat(F.array_repeat(F.lit(START), order), tokenize(seed))
    return F.array_join(F.slice(tokens, -order, order), " ")


def sequence_key(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def growth_label(growth: Column) -> Column:
    return F.format_string("%+.0f%%", growth * 100)


def percentage_label(count: Column, total: Column) -> Column:
    """Share of the total with one decimal; 0.0% of nothing."""
    share = F.when(total > 0, F.round(count / total * 100, 1)).otherwise(F.lit(0.0))
    return F.concat(F.format_number(share, 1), F.lit("%"))


def currency_label(value: Column) -> Column:
    return F.concat(F.when(value >= 0, "+").otherwise("-"), F.lit("$"), F.format_number(F.round(F.abs(value)), 0))


def group_key(identifier: Column, by: str | Callable[[Column], Column]) -> Column:
    """Group of a node: ``segment:n`` (split at white space, ``>`` and ``/``; too large an n gives the first), ``domain`` (host of a URL, else the first segment), ``prefix`` (the first segment), or a function of the column. Blank gives ``unknown``."""
    if callable(by):
        made = by(identifier)
    else:
        segments = F.filter(F.split(identifier, r"[\s>]+|/"), lambda s: s != "")
        first = F.try_element_at(segments, F.lit(1))
        kind, _, n = by.partition(":")
        if kind == "segment" and n.isdigit():
            made = F.coalesce(F.try_element_at(segments, F.lit(int(n) + 1)), first)
        elif by == "domain":
            made = F.coalesce(F.nullif(F.regexp_extract(identifier, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]+)", 1), F.lit("")), first)
        elif by == "prefix":
            made = first
        else:
            raise ValueError(f"no such grouping: {by}")
    return F.when(F.trim(F.coalesce(identifier, F.lit(""))) == "", "unknown").otherwise(F.coalesce(F.nullif(made, F.lit("")), F.lit("unknown")))


def format_bytes(size: float, precision: int = 2) -> str:
    """B, KB, MB, GB, TB with base 1024."""
    size = max(0.0, float(size))
    units = ("B", "KB", "MB", "GB", "TB")
    k = 0
    while size >= 1024 and k < len(units) - 1:
        size /= 1024
        k += 1
    return f"{round(size, precision):g} {units[k]}"
