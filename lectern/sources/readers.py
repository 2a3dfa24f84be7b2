"""Readers. Schemas are always given; nothing is inferred."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern import fixed
from lectern.functions.arrays import majority_domain
from lectern.functions.text import WHITESPACE, advanced_score, html_to_text, strip, unescape, urgency_score
from lectern.plans.scratch import once
from lectern.sources.json_arrays import read_json_array  # noqa: F401

ITEM_SCHEMA = (
    "question_id bigint, title string, body string, tags array<string>, score int, view_count int, "
    "answer_count int, creation_date bigint, link string"
)
PAGE_SCHEMA = f"items array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in ITEM_SCHEMA.split(', '))}>>, has_more boolean, quota_remaining int, backoff double"


def array_objects(documents: DataFrame, schema: StructType | str, col: str = "value") -> DataFrame:
    """Texts that each hold one JSON array to its objects; other elements are dropped, a text
    that is no array is an error."""
    text = strip(col)
    elements = F.from_json(text, "array<string>")
    not_array = F.raise_error(F.lit("the document must be a JSON array")).cast("array<string>")
    checked = F.when(elements.isNotNull() & text.startswith("["), elements).otherwise(not_array)
    objects = documents.select(F.explode(checked).alias("o")).where(strip("o").startswith("{"))
    return objects.select(F.from_json("o", schema).alias("r")).select("r.*")


def read_table(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Splittable tables: parquet, json (lines) or csv (with header)."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def read_optional(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """The table, or an empty one when the path does not exist."""
    try:
        return read_table(spark, path, schema, fmt)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Several splits as one table with the split name as a column."""
    out = None
    for name, path in paths.items():
        part = read_table(spark, path, schema, fmt).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no splits given")
    return out


def read_pages(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """Landed API pages (JSON lines) to one row per item, with the page's paging fields."""
    pages = spark.read.schema(PAGE_SCHEMA).json(path)
    return pages.select(
        "has_more", "quota_remaining", "backoff", F.lit(strategy).alias("source_strategy"), F.inline("items")
    )


def question_candidates(items: DataFrame, min_title: int = 8, min_body: int = 20) -> DataFrame:
    """Items to question rows: plain text, domain from tags, signals; too short ones dropped."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    # entities are resolved on the joined tags; the separator cannot occur in a tag
    clean_tags = F.when(F.size(tags) > 0, F.split(unescape(F.array_join(tags, "\n")), "\n")).otherwise(tags)
    plain = once(
        items.where(F.col("question_id").isNotNull()),
        {
            "title": unescape(F.coalesce("title", F.lit(""))),
            "body": html_to_text("body"),
            "tags": clean_tags,
        },
    )
    long_enough = plain.where((F.length(strip("title")) >= min_title) & (F.length(strip("body")) >= min_body))
    text = F.concat_ws(" ", "title", "body")
    return long_enough.withColumns(
        {
            "domain": majority_domain("tags"),
            "urgency_signal": urgency_score(text),
            "advanced_signal": advanced_score(text, "tags"),
        }
    )


def read_vec(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """Word vectors from text lines ``word f1 .. fd``: ``word, vec``, first line per word.

    The width comes from the ``n dim`` header, else from the first vector line, else 300. Lines
    of another width or with a value that is no number are skipped.
    """
    lines = spark.read.text(path)
    parts = F.split(F.regexp_replace(strip("value"), "[\\t ]+", " "), " ")
    if dim is None:
        dim = _vector_width([r["value"] for r in lines.limit(20).collect()])
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    split = lines.select(parts.alias("p"), place.alias("place")).where(F.size("p") == dim + 1)
    numbers = F.transform(F.slice("p", 2, dim), lambda x: x.try_cast("float"))
    parsed = split.select(F.get("p", F.lit(0)).alias("word"), numbers.alias("vec"), "place")
    sound = parsed.where(F.forall("vec", lambda x: x.isNotNull()))
    return sound.groupBy("word").agg(F.min_by("vec", "place").alias("vec"))


def _vector_width(first_lines: list[str]) -> int:
    head = first_lines[0].strip(WHITESPACE).split() if first_lines else []
    if len(head) == 2 and all(x.isdigit() for x in head):
        return int(head[1])
    widths = [len(line.split()) - 1 for line in first_lines if len(line.split()) >= 2]
    return widths[0] if widths else 300


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """A vocabulary document ``{"word2idx": {..}}`` as ``word, idx``."""
    documents = spark.read.text(path, wholetext=True)
    table = F.from_json("value", "word2idx map<string,int>")["word2idx"]
    return documents.select(F.explode(table).alias("word", "idx"))


def read_emotions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw emotion rows: ``text, labels (string), id, language``."""
    return read_table(spark, path, "text string, labels string, id string, language string", fmt)


def emotion_names(df: DataFrame) -> DataFrame:
    """Label id strings to ids and names."""
    from lectern.functions.arrays import map_ids
    from lectern.functions.text import parse_int_list

    ids = df.withColumn("label_ids", parse_int_list("labels"))
    return ids.withColumn("emotion_names", map_ids("label_ids", fixed.EMOTION_IDS))
