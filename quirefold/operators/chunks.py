"""The row that all operators share: a labelled text chunk with an explicit place in its document.

chunks: doc_id, section_no, seq, text, label, meta. Order is (doc_id, section_no, seq); nothing relies on physical order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("section_no", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)
KEY = ["doc_id", "section_no"]
ORDER = [*KEY, "seq"]
# The labels of each kind.
HEADERS = ("section_header", "title", *(f"h{n}" for n in range(1, 6)))
BODY = ("text", "list_item", "formula", "paragraph")
PAGE_EDGES = ("page_header", "page_footer")


def is_header(label: Column) -> Column:
    return F.coalesce(label.isin(*HEADERS), F.lit(False))


def is_body(label: Column) -> Column:
    """Labels that count as body text when they come next. No label is processed as body but does not count here."""
    return F.coalesce(label.isin(*BODY), F.lit(False))


def is_footnote(label: Column) -> Column:
    return F.coalesce(label == "footnote", F.lit(False))


def is_page_header(label: Column) -> Column:
    return F.coalesce(label == "page_header", F.lit(False))


def is_page_footer(label: Column) -> Column:
    return F.coalesce(label == "page_footer", F.lit(False))


def is_skipped(label: Column, include_footnotes: bool = False) -> Column:
    edge = is_page_header(label) | is_page_footer(label)
    return edge if include_footnotes else edge | is_footnote(label)


def no_meta() -> Column:
    return F.create_map().cast("map<string,string>")


def merge_meta(first: Column, second: Column) -> Column:
    """Both maps; the second wins where both have a key."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(kept, second)


def meta_line(meta: Column) -> Column:
    """`key: value` pairs in order of key, joined by bars."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")


def from_documents(docs: DataFrame, lines_per_page: int | None = None) -> DataFrame:
    """A text chunk for each line of a document; with lines_per_page, also a page number."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))
    page = F.create_map(F.lit("page_#"), (F.floor(F.col("seq") / lines_per_page) + 1).cast("string")) if lines_per_page else no_meta()
    return lines.select("doc_id", F.lit(0).alias("section_no"), "seq", "text", F.lit("text").alias("label"), page.alias("meta"))


def from_conversations(turns: DataFrame, labels: dict[str, str]) -> DataFrame:
    """A chunk for each turn, labelled by role; other roles are text."""
    label = F.coalesce(*(F.when(F.col("role") == role, F.lit(name)) for role, name in labels.items()), F.lit("text"))
    return turns.select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("section_no"), F.col("turn").cast("int").alias("seq"), "text", label.alias("label"), no_meta().alias("meta"))


def from_strings(spark, texts: list[str]) -> DataFrame:
    """A document of one chunk for each raw string."""
    rows = [(k, 0, 0, t, "text", {}) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNK)
