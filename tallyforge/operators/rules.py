"""Rule sets over lists: copy limits with exceptions, zones, legality and brackets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Predicates, first_match
from ..functions.text import word_number
from .rank import running_allowance
from .tables import dealt


def load_rules(path: str) -> dict:
    """A rule file; read again for every run, so edits count at once."""
    with open(path) as f:
        return json.load(f)


def copy_limit(df: DataFrame, rule: dict) -> Column:
    """Each row's limit: the first exception that fits (a number, null for none, or read from the text), else the default.

    rule: {"default": n, "exceptions": [{"when": predicate, "limit": n | None | {"field": f, "pattern": p}}], "restricted": predicate}
    """
    p = Predicates(df)
    cases = []
    if rule.get("restricted"):
        cases.append((p.compile(rule["restricted"]), F.lit(1)))
    for e in rule.get("exceptions", ()):
        limit = e["limit"]
        value = word_number(F.nullif(next(iter(p.captures(limit["field"], limit["pattern"]).values())), F.lit(""))) if isinstance(limit, dict) else F.lit(limit).cast("int")
        cases.append((p.compile(e["when"]), value))
    return first_match(cases, F.lit(rule["default"]).cast("int"))


def limited(lines: DataFrame, rule: dict, key: str, order: list[Column]) -> DataFrame:
    """Adds limit, automatic quantity (what still fits, in order) and quantity (an override wins, 0 included)."""
    rows = dealt(lines.withColumn("limit", copy_limit(lines, rule)), key)
    rows = running_allowance(rows, [key], order, "detected", F.col("limit"), "automatic")
    return rows.withColumn("quantity", F.coalesce("override", "automatic"))


def copy_issues(rows: DataFrame, key: str) -> DataFrame:
    """Keys over their limit: an error if the quantity still exceeds it, a warning if it was cut."""
    per = rows.groupBy(key).agg(F.sum("detected").alias("detected"), F.sum("quantity").alias("quantity"), F.max("limit").alias("limit"))
    code = F.when(F.col("quantity") > F.col("limit"), "copy_limit_violation").when(F.col("detected") > F.col("limit"), "copy_limit_exceeded")
    rows = per.withColumn("code", code).where("code is not null")
    return rows.withColumn("severity", F.when(F.col("code") == "copy_limit_violation", "error").otherwise("warning"))


def legality(status: Column) -> Column:
    return F.when(status == "banned", "banned").when(F.coalesce(status, F.lit("not_legal")).isin("legal", "restricted"), F.lit(None)).otherwise("not_legal")


def zone_issues(rows: DataFrame, group: list[str], zones: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """Zones outside their least and most, with the gap; unknown zones are issues if they hold anything."""
    per = rows.groupBy(*group, "zone").agg(F.sum("quantity").alias("quantity"))
    cases = []
    for z, (least, most) in zones.items():
        if least is not None:
            cases.append(((F.col("zone") == z) & (F.col("quantity") < least), F.struct(F.lit("too_few").alias("code"), (F.lit(least) - F.col("quantity")).cast("long").alias("gap"))))
        if most is not None:
            cases.append(((F.col("zone") == z) & (F.col("quantity") > most), F.struct(F.lit("too_many").alias("code"), (F.col("quantity") - F.lit(most)).cast("long").alias("gap"))))
    cases.append((~F.col("zone").isin(*zones) & (F.col("quantity") > 0), F.struct(F.lit("unknown_zone").alias("code"), F.col("quantity").cast("long").alias("gap"))))
    found = first_match(cases, F.lit(None))
    return per.withColumn("__found", found).where("__found is not null").select(*group, "zone", "quantity", "__found.code", "__found.gap")


def bracket(per_list: DataFrame, limits: list[tuple[int, dict[str, int]]]) -> Column:
    """The smallest bracket whose limits (tag column: most) all hold; the last is open."""
    cases = []
    for level, most in limits:
        ok = F.lit(True)
        for tag, n in most.items():
            ok = ok & (F.col(tag) <= n)
        cases.append((ok, F.lit(level)))
    return first_match(cases, F.lit(limits[-1][0] + 1))


def pips(cost: Column) -> Column:
    """(color, weight) of each coloured symbol: hybrids split, twobrid and phyrexian halves count a half."""
    symbols = F.regexp_extract_all(cost, F.lit(r"\{([^}]+)\}"), 1)
    colors = lambda s: F.filter(F.split(s, "/"), lambda x: x.isin("W", "U", "B", "R", "G"))
    return F.flatten(F.transform(symbols, lambda s: F.transform(colors(s), lambda c: F.struct(c.alias("color"), F.when(F.instr(s, "/") > 0, 0.5).otherwise(1.0).alias("weight")))))
