"""Text functions: normalised names, tokens, numbers, labels and formats."""

from __future__ import annotations

import re

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin letters with marks and what they decompose to, from the Unicode data.
_LATIN = {chr(i): unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode() for i in range(0xC0, 0x250)}
_LATIN = {k: v for k, v in _LATIN.items() if len(v) == 1}


def name_norm(x: Column) -> Column:
    """Lower-case ASCII words joined by a space; marks are dropped from Latin letters, other foreign characters go."""
    plain = F.translate(x, "".join(_LATIN), "".join(_LATIN.values()))
    plain = F.regexp_replace(F.regexp_replace(plain, r"\p{Z}", " "), r"[^\x00-\x7F]", "")
    return F.array_join(F.regexp_extract_all(F.lower(plain), F.lit("([a-z0-9_]+)"), 1), " ")


@F.pandas_udf(T.StringType())
def name_norm_exact(x: pd.Series) -> pd.Series:
    """The same over all of Unicode: compatibility decomposition, ASCII only."""
    plain = x.map(lambda s: None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().casefold())
    return plain.str.findall(r"\w+").str.join(" ")


def tokens(x: Column) -> Column:
    return F.filter(F.split(name_norm(x), " "), lambda t: t != "")


def grams(x: Column, n: int = 3) -> Column:
    """The distinct character n-grams of a text padded with two spaces before and one after."""
    padded = F.concat(F.lit("  "), x, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1))), lambda i: F.substring(padded, i, F.lit(n))))


def all_words_match(words: Column, wanted: list[str], prefix: bool = True) -> Column:
    """Every wanted token opens (or is within) some word."""
    def some(t: str) -> Column:
        return F.exists(words, lambda w: w.startswith(t) if prefix else w.contains(t))

    return reduce(lambda a, b: a & b, map(some, wanted), F.lit(True))


def collector_number(x: Column) -> Column:
    """Before a slash, trimmed, without leading zeros; a suffix stays, and all zeros are one zero."""
    head = F.trim(F.element_at(F.split(x, "/"), 1))
    digits, suffix = F.regexp_extract(head, r"^0*(\d+)(.*)$", 1), F.regexp_extract(head, r"^0*(\d+)(.*)$", 2)
    return F.when(digits != "", F.concat(digits, suffix)).otherwise(head)


#: Number words.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
}


def word_number(x: Column) -> Column:
    """A number in digits or as a word, else null."""
    table = F.create_map(*[F.lit(v) for kv in NUMBER_WORDS.items() for v in kv])
    return F.coalesce(x.try_cast("int"), table[F.lower(x)])


#: The order in which a type line is filed under its first matching group.
TYPE_GROUPS = ["Land", "Creature", "Planeswalker", "Instant", "Sorcery", "Artifact", "Enchantment", "Battle"]


def type_group(x: Column, groups: list[str] = TYPE_GROUPS, other: str = "Other") -> Column:
    out = F.lit(other)
    for g in reversed(groups):
        out = F.when(F.lower(x).contains(g.lower()), g).otherwise(out)
    return out


def display_name(lang: Column, layout: Column, name: Column, front: Column, translated: Column) -> Column:
    """The translated name if the print is not English, the front name of two-faced items, else the full name."""
    two_faced = layout.isin("transform", "modal_dfc", "double_faced_token")
    return F.coalesce(F.when(lang != "en", translated), F.when(two_faced, front), name)


def remapped(x: Column, table: dict[str, str]) -> Column:
    codes = F.create_map(*[F.lit(v) for kv in table.items() for v in kv]) if table else F.create_map().cast("map<string,string>")
    return F.coalesce(codes[F.lower(x)], F.upper(x))


def grid_label(x: Column, y: Column) -> Column:
    """Which third of a picture a point (0 to 1) lies in."""
    across = F.when(x < 1 / 3, "left").when(x < 2 / 3, "middle").otherwise("right")
    down = F.when(y < 1 / 3, "top").when(y < 2 / 3, "center").otherwise("bottom")
    return F.concat_ws(" ", down, across)


def condition_grade(wear: Column) -> Column:
    """Grade of a worn fraction."""
    return F.when(wear < 0.02, "NM").when(wear < 0.06, "LP").when(wear < 0.14, "MP").when(wear < 0.3, "HP").otherwise("DMG")


def money_text(x: Column, sign: str = "R$ ") -> Column:
    """Two decimals with a point for thousands and a comma before cents."""
    return F.concat(F.lit(sign), F.translate(F.format_number(x, 2), ",.", ".,"))


def fixed(x: Column, digits: int) -> Column:
    """A number of at least zero with so many decimals, halves rounded up.

    Rounded to nine decimals first, so that the order in which a mean was added up does not decide a half.
    """
    unit = 10**digits
    whole = F.floor(F.round(x, 9) * unit + 0.5).cast("long")
    return F.concat(F.floor(whole / unit).cast("string"), F.lit("."), F.lpad((whole % unit).cast("string"), digits, "0"))


def relative_day(day: Column, today: Column) -> Column:
    d = F.datediff(today, day)
    return F.when(d == 0, "today").when(d == 1, "yesterday").when((d > 1) & (d < 7), F.concat(d.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "dd/MM/yyyy"))


def list_key(items: Column) -> Column:
    """A cache key that does not depend on the order of the items."""
    return F.sha1(F.to_json(F.sort_array(items)).cast("binary"))


def message(template: str, values: dict[str, Column]) -> Column:
    """The template with its {names} filled in; a template that names a value that is not given stays as it is."""
    parts = re.split(r"\{(\w+)\}", template)
    if any(name not in values for name in parts[1::2]):
        return F.lit(template)
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def url_text(x: Column) -> Column:
    """Percent-encoded text in which only letters, digits and -_.~ stand for themselves."""
    out = F.url_encode(x)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def dotted(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where the path leads nowhere."""
    return F.get_json_object(json, "$." + path)
