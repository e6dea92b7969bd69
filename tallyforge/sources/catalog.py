"""Nested JSON catalogues: line-tolerant reading and flattening to a wide table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACE = "name string, type_line string, oracle_text string, mana_cost string, colors array<string>, printed_name string, flavor_name string, illustration_id string"
SCHEMA = f"""id string, oracle_id string, lang string, name string, layout string, set string, set_type string, collector_number string,
released_at string, rarity string, type_line string, oracle_text string, mana_cost string, cmc double, colors array<string>,
color_identity array<string>, produced_mana array<string>, keywords array<string>, finishes array<string>, games array<string>,
legalities map<string,string>, prices map<string,string>, promo boolean, frame_effects array<string>, border_color string,
highres_image boolean, image_status string, printed_name string, flavor_name string, illustration_id string,
card_faces array<struct<{', '.join(x.replace(' ', ':', 1) for x in FACE.split(', '))}>>"""


def read_json_lines(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """JSON objects by line, also from dumps of one array: brackets, blank lines and closing commas are passed over.

    gzip files are read by one task each and dealt out afterwards.
    """
    line = F.regexp_replace(F.trim(F.col("value")), r",$", "")
    rows = spark.read.text(path).select(line.alias("value")).where(~F.col("value").isin("", "[", "]"))
    return rows.select(F.from_json("value", schema).alias("row")).where("row is not null").select("row.*")


def kind(layout: Column, set_type: Column, type_line: Column) -> Column:
    """What a row is; the first rule that fits counts."""
    low = F.lower(type_line)
    return (
        F.when(layout.isin("token", "double_faced_token") | low.startswith("token"), "token")
        .when((layout == "emblem") | low.startswith("emblem"), "emblem")
        .when(layout == "art_series", "art_series")
        .when(layout.isin("planar", "scheme", "vanguard") | (set_type == "memorabilia"), "other")
        .otherwise("card")
    )


def _joined(field: str, glue: str) -> Column:
    parts = F.filter(F.transform("card_faces", lambda f: f[field]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(parts) > 0, F.array_join(parts, glue))


def flattened(cards: DataFrame) -> DataFrame:
    """One row a print: a card's own field, else its first face's, else the faces' joined."""
    first = F.get(F.col("card_faces"), F.lit(0))
    return cards.select(
        "id", F.coalesce("oracle_id", "id").alias("oracle_id"), "lang", F.col("name").alias("name_en"),
        F.coalesce(first["name"], F.col("name")).alias("front_name"), "layout", F.col("set").alias("set_code"), "set_type", "collector_number",
        F.try_to_date("released_at").alias("released_at"), "rarity",
        F.coalesce("type_line", _joined("type_line", " // ")).alias("type_line"),
        F.coalesce("oracle_text", _joined("oracle_text", "\n//\n")).alias("oracle_text"),
        F.coalesce("mana_cost", first["mana_cost"], F.lit("")).alias("mana_cost"), "cmc",
        F.coalesce("colors", first["colors"], F.array().cast("array<string>")).alias("colors"), "color_identity", "produced_mana", "keywords",
        "finishes", "games", "legalities", "prices", F.coalesce("promo", F.lit(False)).alias("promo"),
        F.coalesce("printed_name", _joined("printed_name", " // ")).alias("printed_name"), "flavor_name",
        F.coalesce("illustration_id", first["illustration_id"]).alias("illustration_id"), F.to_json("card_faces").alias("faces"),
        "frame_effects", "border_color", F.coalesce("highres_image", F.lit(False)).alias("highres"), "image_status",
        kind(F.col("layout"), F.col("set_type"), F.coalesce("type_line", F.lit(""))).alias("kind"),
    )


def names(flat: DataFrame) -> DataFrame:
    """(oracle_id, lang, name): every distinct name an item goes by."""
    found = F.array_compact(F.array("name_en", "front_name", "flavor_name", "printed_name"))
    return flat.select("oracle_id", "lang", F.explode(found).alias("name")).distinct()


def copied(df: DataFrame, columns: list[str], blank: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """The named columns for another store, some of them emptied, of the rows that go there."""
    rows = df if where is None else df.where(where)
    kinds = dict(df.dtypes)
    return rows.select(*[F.lit(None).cast(kinds[c]).alias(c) if c in blank else F.col(c) for c in columns])


def sets_from_json(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an answer {"data": [...]}; a code that comes again keeps its last row."""
    schema = "data array<struct<code:string,name:string,set_type:string,released_at:string,card_count:int>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("data").alias("at", "x"))
    last = rows.groupBy("x.code").agg(F.max_by("x", "at").alias("x"))
    return last.select("x.*").withColumn("released_at", F.try_to_date("released_at"))
