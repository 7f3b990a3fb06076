"""Named scalar rules: platforms, tiers, sentinels, label filters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def classify_platform(c: Column) -> Column:
    """mac, win, linux or other; darwin is asked before win, which it contains."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike("darwin|mac"), "mac").when(low.contains("win"), "win").when(low.contains("linux"), "linux").otherwise("other")


def platform_or_mac(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "mac").otherwise(classify_platform(c))


def platform_or_unknown(c: Column) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").otherwise(classify_platform(c))


def canonical_tier(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)) == "tiny", "small").otherwise(F.lower(F.trim(c)))


#: What a note of a run out of memory holds, the tiers, and the variants that are measured.
OUT_OF_MEMORY = ("oom", "out of memory", "memory limit", "cannot allocate", "bad_alloc", "bad allocation", "exited -9", "sigkill", "killed")
TIERS = ("small", "medium", "large", "ood_large", "ood_xlarge", "ood_large1", "ood_large2", "ood_large3")
VARIANTS = ("baseline", "patched")


def out_of_memory(note: Column) -> Column:
    return F.lower(F.coalesce(note, F.lit(""))).rlike("|".join(map(re.escape, OUT_OF_MEMORY)))


def row_kind(sec: Column, variant: Column, tier: Column, note: Column) -> Column:
    """measurement (seconds and a variant), oom or sentinel (neither, but a known tier and a note), else none. All are text."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    known = F.when(F.trim(tier) == "tiny", "small").otherwise(F.trim(tier)).isin(*TIERS)
    sentinel = blank(sec) & blank(variant) & F.coalesce(known, F.lit(False)) & ~blank(note)
    measured = ~blank(sec) & F.coalesce(F.trim(variant).isin(*VARIANTS), F.lit(False))
    return F.when(measured, "measurement").when(sentinel & out_of_memory(note), "oom").when(sentinel, "sentinel").otherwise("none")


_CLAUSE = re.compile(r"\s*([\w.-]+)\s*(>=|<=|!=|=|>|<)\s*(.+?)\s*$")


def label_filter(expression: str, labels: Column) -> Column:
    """A condition on a map of labels: clauses `key op value`, joined by commas. Numbers compare as numbers, text by = and != only."""
    out = F.lit(True)
    for clause in filter(str.strip, expression.split(",")):
        m = _CLAUSE.match(clause)
        if not m:
            raise ValueError(f"not a clause: {clause!r}")
        key, op, value = m.groups()
        have = F.element_at(labels, key)
        try:
            left, right = have.try_cast("double"), F.lit(float(value))
        except ValueError:
            if op not in ("=", "!="):
                raise ValueError(f"text is compared by = or !=: {clause!r}") from None
            left, right = have, F.lit(value)
        test = {"=": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}[op]
        out = out & F.coalesce(test, F.lit(False))
    return out


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_key(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *columns), 256)
