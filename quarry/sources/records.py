"""Sources and sinks: record files, raw page lines, and the adapters that give the driver's tables the shape of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import config as c
from quarry.functions import text as X
from quarry.operators.ranks import range_of, with_places

RAW_PAGE = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("title", T.StringType()), T.StructField("api", T.StringType()), T.StructField("fetched_at", T.StringType()), T.StructField("wikitext", T.StringType())]
)


def read_record_files(spark: SparkSession, path: str, min_bytes: int = c.MIN_FILE_BYTES) -> DataFrame:
    """(file, pos, text) of the blocks of all *.txt files over min_bytes; a block ends at a line that begins with sixty '='; empty blocks go.

    A file is one row while it is split; record files are written in parts of bounded size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).where(F.col("length") > min_bytes)
    body = F.decode("content", "UTF-8")
    blocks = F.split(F.concat(F.lit("\n"), F.replace(body, F.lit("\r\n"), F.lit("\n"))), r"\n={60}[^\n]*(?=\n|$)")
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.posexplode(blocks).alias("pos", "text"))
    return rows.select("file", F.col("pos").cast("long").alias("pos"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def write_record_files(records: DataFrame, path: str) -> None:
    """K1: blocks, each followed by the separator line and a blank line; order within a part is by (file, pos)."""
    line = F.concat("text", F.lit("\n" + c.SEPARATOR + "\n"))
    records.repartitionByRange("file", "pos").sortWithinPartitions("file", "pos").select(line.alias("value")).write.mode("overwrite").text(path)


def read_raw_pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """S3: raw page lines; malformed lines are skipped, or, strict, fail the read."""
    return spark.read.schema(RAW_PAGE).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    """K2, K4."""
    df.write.mode("overwrite").option("compression", compression or "none").json(path)


def with_doc_ids(blocks: DataFrame) -> DataFrame:
    """doc_id: the place in (file, pos) order from 0. Counts per file are summed first, so that no one task orders all rows."""
    sizes = blocks.groupBy("file").agg(F.count("*").alias("n"))
    before = with_places(sizes, None, ["file"], F.lit(0), F.col("n")).select("file", F.col("before").alias("ahead"))
    placed = with_places(blocks, "file", ["pos"], range_of(blocks, "pos")).drop("before").join(before, "file")
    return placed.withColumn("doc_id", (F.col("ahead") + F.col("place")).cast("long")).drop("ahead", "place")


def _is_stop(line: Column, stops: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for s in stops:
        found = found | F.startswith(line, F.lit(s))
    return found


def schema_lines(text: Column, stops: tuple[str, ...] = c.STOP_SECTIONS) -> Column:
    """The lines after the headline, up to the first stop section."""
    lines = F.split(text, "\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    stop = F.array_position(F.transform(body, lambda x: _is_stop(x, stops)), True)
    return F.when(stop > 0, F.slice(body, F.lit(1), (stop - 1).cast("int"))).otherwise(body)


def fields(text: Column) -> Column:
    """[(label, value)] in order, repeats kept: schema lines with ': '."""
    rows = F.filter(schema_lines(text), lambda x: F.contains(x, F.lit(": ")))
    return F.transform(rows, lambda x: F.struct(F.substring_index(x, ": ", 1).alias("label"), F.trim(F.substring(x, F.locate(": ", x) + 2, F.length(x))).alias("value")))


def field_value(text: Column, label: str) -> Column:
    """The first value of the label, '' if it isn't there."""
    found = F.filter(schema_lines(text), lambda x: F.startswith(x, F.lit(label + ": ")))
    return F.coalesce(F.trim(F.substring(F.get(found, F.lit(0)), F.lit(len(label) + 3), F.lit(1 << 30))), F.lit(""))


def field_values(text: Column, labels: list[str]) -> Column:
    """The labels' first values, '' where there is none; the text is split once."""
    first = lambda lines, x: F.coalesce(F.trim(F.substring(F.get(F.filter(lines, lambda y: F.startswith(y, F.lit(x + ": "))), F.lit(0)), F.lit(len(x) + 3), F.lit(1 << 30))), F.lit(""))
    return F.get(F.transform(F.array(schema_lines(text)), lambda lines: F.array(*[first(lines, x) for x in labels])), F.lit(0))


def field_count(text: Column) -> Column:
    """Schema lines with ': ', Kind and Page among them."""
    return F.size(F.filter(schema_lines(text), lambda x: F.contains(x, F.lit(": "))))


def narrative(text: Column) -> Column:
    """What follows History:, else Synopsis:."""
    at = lambda mark: F.when(F.locate("\n" + mark, text) > 0, F.substring(text, F.locate("\n" + mark, text) + len(mark) + 1, F.length(text)))
    return F.regexp_replace(F.coalesce(at("History:"), at("Synopsis:"), F.lit("")), r"^\s+|\s+$", "")


def records(blocks: DataFrame) -> DataFrame:
    """The canonical table: blocks (doc_id, file, pos, text) with the derived columns that every query operator reads."""
    t = F.col("text")
    page = field_value(t, "Page")
    return blocks.select(
        "doc_id", "file", "pos", "text", X.headline(t).alias("headline"), fields(t).alias("fields"), narrative(t).alias("narrative"), F.coalesce(F.nullif(field_value(t, "Kind"), F.lit("")), F.lit("unknown")).alias("kind"),
        page.alias("page"), F.length(t).alias("size"), field_count(t).alias("field_count"), t.rlike("(?m)^Reality:").alias("is_entity"),
        F.startswith(F.lower(field_value(t, "Reality")), F.lit(c.MAIN_REALITY_PREFIX)).alias("is_main"), (page != "").alias("has_page"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a corpus: (doc_id, text, headline, size, source)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", "text", X.headline(F.col("text")).alias("headline"), F.length("text").alias("size"), "source")
