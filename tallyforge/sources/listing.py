"""Text listings: items with counts, and player lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers and the zones they open.
ZONES = {
    "commander": "commander", "commanders": "commander", "comandante": "commander", "comandantes": "commander",
    "deck": "deck", "main": "deck", "maindeck": "deck", "mainboard": "deck",
    "sideboard": "sideboard", "side": "sideboard", "companion": "sideboard",
    "maybeboard": "maybeboard", "maybe": "maybeboard", "talvez": "maybeboard", "considering": "maybeboard",
}
#: Headers of a list's own description, which give no item.
ABOUT = ("about", "name")


def exploded_lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "raw"))


def _counted(line: Column) -> tuple[Column, Column]:
    """The count that opens a line (digits, perhaps an x, then space before more text) and the rest of the line."""
    count = F.regexp_extract(line, r"^([0-9]+)\s*x?\s+\S", 1)
    rest = F.when(count == "", line).otherwise(F.regexp_replace(line, r"^[0-9]+\s*x?\s+", ""))
    return F.coalesce(F.nullif(count, F.lit("")).try_cast("int"), F.lit(1)), rest


def _marked(line: Column) -> tuple[Column, Column]:
    """The marks that close a line (*F*, [words], ^words^), joined, and the line before them."""
    marks = F.regexp_extract(line, r"\S((?: +(?:[*]\p{Alpha}[*]|\^[^\^]*\^|\[[^\[\]]*\]))+)$", 1)
    return F.trim(marks), F.trim(F.substring(line, F.lit(1), F.char_length(line) - F.char_length(marks)))


def _coded(line: Column, marks: Column) -> tuple[Column, Column, Column]:
    """Name, set code and collector number: a code of 2 to 6 signs in brackets after the name, perhaps with a number.

    A code in square brackets may stand among the marks, where it is the first.
    """
    closing = r" +[\[(](\w{2,6})[)\]](?: +([-★\w]+))?$"
    code, number = (F.regexp_extract(line, r"\S" + closing, i) for i in (1, 2))
    among = F.regexp_extract(marks, r"^\[(\w{2,6})\]", 1)
    name = F.when(code == "", line).otherwise(F.trim(F.regexp_replace(line, closing, "")))
    return name, F.lower(F.coalesce(F.nullif(code, F.lit("")), F.nullif(among, F.lit("")))), F.nullif(number, F.lit(""))


def parsed_listing(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, line_no, raw) as items with their zone; a header counts for the lines after it.

    A header may stand between slashes, number signs and colons. Blank lines, comments, headers and descriptions give no
    item. Without a count, the quantity is one; a mark [Commander...] moves one item to that zone.
    """
    # each step is a column of its own, so that an expression is evaluated once a line
    line, head, opens = F.col("__line"), F.col("__head"), F.col("__opens")
    rows = lines.withColumn("__line", F.regexp_replace(F.trim(F.regexp_replace("raw", r"\s", " ")), " +", " "))
    rows = rows.withColumn("__head", F.lower(F.regexp_replace(line, r"^[/# :]+|[/# :]+$", "")))
    zones = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    rows = rows.withColumn("__opens", F.when(~line.rlike("^[0-9]"), F.try_element_at(zones, head)))
    about = head.isin(*ABOUT) | F.lower(line).startswith("name ")
    item = opens.isNull() & (line != "") & ~line.startswith("//") & ~line.startswith("#") & ~about
    rows = rows.select(*keys, "line_no", "__line", "__opens", item.alias("__item"))
    zone = F.last("__opens", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("zone", F.coalesce(zone, F.lit("deck"))).where("__item")
    for step, names in ((_counted, ("__quantity", "__counted")), (_marked, ("__marks", "__rest")), (_coded, ("__name", "__code", "__number"))):
        given = {_counted: (line,), _marked: (F.col("__counted"),), _coded: (F.col("__rest"), F.col("__marks"))}[step]
        rows = rows.withColumns(dict(zip(names, step(*given), strict=True)))
    quantity, marks, name, code, number = (F.col(f"__{c}") for c in ("quantity", "marks", "name", "code", "number"))
    first = (F.col("zone") == "commander") | F.lower(marks).contains("[commander")
    finish = F.when(marks.contains("*E*"), "etched").when(marks.contains("*F*"), "foil").otherwise("nonfoil")
    return rows.select(
        *keys, "line_no", F.when(first, "commander").otherwise(F.col("zone")).alias("zone"), quantity.alias("quantity"), name.alias("name"), code.alias("set_code"),
        number.alias("collector_number"), finish.alias("finish"), first.alias("is_commander"),
    )


def player_names(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Names by line without numbers and bullets; of names that differ in case only, the first stays."""
    name = F.trim(F.regexp_replace("raw", r"^\s*(?:\d+[.)-]?|[-*•])?\s*", ""))
    rows = exploded_lines(df, keys, text).withColumn("name", name).where("name <> ''")
    w = Window.partitionBy(*keys, F.lower("name")).orderBy("line_no")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select(*keys, "line_no", "name")


def export_line(style: str, quantity: Column, name: Column, set_code: Column, number: Column, finish: Column) -> Column:
    """A list line as other tools read it: plain, with set and number, with a foil mark, or upper-case codes."""
    plain = F.concat_ws(" ", quantity.cast("string"), name)
    if style == "plain":
        return plain
    code = F.upper(set_code) if style in ("marked", "client") else set_code
    full = F.concat_ws(" ", plain, F.when(set_code.isNotNull(), F.concat(F.lit("("), code, F.lit(")"))), number)
    mark = F.when(finish == "foil", "*F*").when(finish == "etched", "*E*")
    return F.concat_ws(" ", full, mark) if style == "marked" else full


def csv_field(x: Column, separator: str = ",") -> Column:
    """A field in quotes if it needs them."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike(f'["\n\r{separator}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(*fields: Column) -> Column:
    return F.concat_ws(",", *[csv_field(f) for f in fields])


def one_text(rows: DataFrame, keys: list[str], order: list[str], line: str, name: str = "text") -> DataFrame:
    """The lines of each key in order, as one text."""
    held = F.transform(F.sort_array(F.collect_list(F.struct(*order, line))), lambda x: x[line])
    return rows.groupBy(*keys).agg(F.array_join(held, "\n").alias(name))
