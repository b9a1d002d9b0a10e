"""Reading and writing packs, text corpora and result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "corpuscle-pack/1"
ENTRY = "lang string, rank int, gram_hex string, n_occurrences long, accepted boolean, bounds map<string, double>"


def write_pack(entries: DataFrame, path: str, meta: dict[str, str] | None = None, vectors: DataFrame | None = None) -> None:
    """Entries as Parquet and a manifest of one JSON row beside them; vectors: token, row, out_row of the entries."""
    entries.write.mode("overwrite").parquet(f"{path}/entries")
    if vectors is not None:
        vectors.select("token", "row", "out_row").write.mode("overwrite").parquet(f"{path}/vectors")
    facts = entries.agg(F.count("*").alias("n_entries"), F.count_if(F.col("accepted")).alias("n_accepted"))
    items = [x for k, v in (meta or {}).items() for x in (F.lit(k), F.lit(v))]
    facts.select(F.lit(FORMAT).alias("format"), "*", (F.create_map(*items) if items else F.create_map().cast("map<string,string>")).alias("meta")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_pack(spark: SparkSession, path: str, require_accepted: bool = True) -> DataFrame:
    """Entries of a pack of this format; by default only those that were accepted."""
    manifest = spark.read.schema("format string, n_entries long, n_accepted long, meta map<string,string>").json(f"{path}/manifest").first()
    if manifest is None or manifest["format"] != FORMAT:
        raise ValueError(f"not a pack of format {FORMAT}: {path}")
    entries = spark.read.parquet(f"{path}/entries")
    return entries.filter("accepted") if require_accepted else entries


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """token, row, out_row of a pack that was written with them."""
    return spark.read.parquet(f"{path}/vectors")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text corpus, a sentence a line, without blank lines."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("text"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("text").write.mode("overwrite").text(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Sentence pairs, cut at the first tab; quotes have no meaning and empty sides go."""
    sides = F.split("value", "\t", 2)
    pairs = spark.read.text(path).select(F.trim(F.get(sides, F.lit(0))).alias("text"), F.trim(F.get(sides, F.lit(1))).alias("pivot_text"))
    return pairs.filter((F.col("text") != "") & (F.col("pivot_text") != ""))


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """lang, i, text of a JSON sample whose `sentences` maps a language to aligned lines."""
    rows = spark.read.schema("sentences map<string, array<string>>").option("multiLine", True).json(path)
    return rows.select(F.explode("sentences").alias("lang", "lines")).select("lang", F.posexplode("lines").alias("i", "text"))


def write_rows(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result rows of JSON lines; keys that the schema does not name are left out, missing ones are null."""
    return spark.read.schema(schema).json(path)


def write_surfaces(entries: DataFrame, path: str) -> None:
    """One JSON object of a pack's surfaces and ids, with a note of what they cannot say; entries: gram_hex, new_id."""
    pairs = entries.select(F.decode(F.unhex("gram_hex"), "utf-8").alias("surface"), F.col("new_id").alias("id"))
    listed = pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("surface", "id")))).alias("tokens"))  # a pack's rows
    listed.select("tokens", F.lit("a surface stands for its run of base tokens and for no other").alias("note")).coalesce(1).write.mode("overwrite").json(path)


def write_assets(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as one compact JSON array, for static pages."""
    for name, rows in tables.items():
        rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def card(entries: DataFrame) -> str:
    """A short text about a pack: counts and the worst bound of each statistic."""
    facts = entries.agg(F.count("*").alias("n"), F.count_if(F.col("accepted")).alias("ok")).first()
    worst = entries.select(F.explode("bounds").alias("name", "value")).groupBy("name").agg(F.max("value").alias("value")).orderBy("name").collect()  # a row for each statistic
    return "\n".join(["# Merge pack", "", f"{facts['n']} entries, {facts['ok']} accepted.", "", "| statistic | worst bound |", "| --- | ---: |", *(f"| {r['name']} | {r['value']:.4g} |" for r in worst)])
