"""Sinks: paragraph, meta and item listings as text, and audio as WAV files.

Listings are ordered lines in a DataFrame, written by Spark with one directory a document. The *_file functions write the
one file of a single document that a reader expects by name; they stream, a partition at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.operators import chunks as C
from quirefold.operators import layout
from quirefold.operators.speech import wav_header


def paragraph_lines(paragraphs: DataFrame) -> DataFrame:
    """doc_id, section_no, para_no, line: each paragraph and an empty line."""
    return paragraphs.select("doc_id", "section_no", "para_no", F.concat("text", F.lit("\n")).alias("line"))


def meta_lines(paragraphs: DataFrame) -> DataFrame:
    """As paragraph_lines, each paragraph under its meta in order of key."""
    return paragraphs.select("doc_id", "section_no", "para_no", F.concat(F.lit("["), C.meta_line(F.col("meta")), F.lit("]\n"), "text", F.lit("\n")).alias("line"))


def write_listing(lines: DataFrame, path: str) -> None:
    """One directory for each document, its lines in order."""
    ordered = lines.repartition("doc_id").sortWithinPartitions("doc_id", *(c for c in ("section_no", "para_no", "line_no") if c in lines.columns))
    ordered.select("doc_id", "line").write.partitionBy("doc_id").text(path)


def _stream(lines: DataFrame) -> Iterator[str]:
    order = [c for c in ("section_no", "para_no", "line_no") if c in lines.columns]
    for row in lines.orderBy(*order).toLocalIterator():
        yield row["line"] + "\n"


def listing_file(lines: DataFrame, path: str | Path | None) -> None:
    if path is None:
        raise ValueError("no path to write to: the document was not read from a file")
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(_stream(lines))


def wav_files(parts: DataFrame, folder: str) -> DataFrame:
    """Writes doc_id.wav of each document into a folder that all workers share; gives doc_id, path and n_bytes. parts: as
    operators.speech.in_order. A document's parts are streamed into its file in order, so no task holds more than one; an
    attempt writes a file of its own, which gets its name when it is whole."""
    rows = parts.repartition("doc_id").sortWithinPartitions("doc_id", "part").select("doc_id", "sample_rate", "pcm")

    def finish(file, n, rate, draft, doc):
        file.seek(0)
        file.write(wav_header(n, rate))
        file.close()
        path = f"{folder}/{doc}.wav"
        os.replace(draft, path)
        return pa.RecordBatch.from_pydict({"doc_id": pa.array([doc], pa.int64()), "path": pa.array([path]), "n_bytes": pa.array([n], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        doc = file = None
        for batch in batches:
            for own, rate, pcm in zip(batch.column("doc_id"), batch.column("sample_rate"), batch.column("pcm"), strict=True):
                if file is None or own.as_py() != doc:
                    if file is not None:
                        yield finish(file, n, last_rate, draft, doc)
                    doc, n, draft = own.as_py(), 0, f"{folder}/.{uuid.uuid4().hex}"
                    file = open(draft, "wb")
                    file.write(wav_header(0, 0))
                last_rate = rate.as_py()
                data = pcm.as_py() or b""
                file.write(data)
                n += len(data)
        if file is not None:
            yield finish(file, n, last_rate, draft, doc)

    return rows.mapInArrow(run, "doc_id bigint, path string, n_bytes bigint")


def wav_file(parts: DataFrame, path: str | Path) -> None:
    """The audio of a single document, streamed to a local file part by part."""
    n, rate = 0, 0
    with open(path, "wb") as out:
        out.write(wav_header(0, 0))
        for row in parts.orderBy("part").toLocalIterator():
            out.write(row["pcm"])
            n, rate = n + len(row["pcm"]), row["sample_rate"]
        out.seek(0)
        out.write(wav_header(n, rate))


def markdown_lines(items: DataFrame) -> DataFrame:
    """doc_id, line_no, line: layout items as Markdown; page headers and footers are left out."""
    mark = F.when(F.col("label") == "section_header", "## ").when(F.col("label") == "list_item", "- ").otherwise("")
    kept = items.filter((F.col("item_kind") == "text") & ~F.col("label").isin(*C.PAGE_EDGES))
    return kept.select("doc_id", F.col("seq").alias("line_no"), F.concat(mark, "text", F.lit("\n")).alias("line"))


def write_markdown(items: DataFrame, path: str) -> None:
    """Layout items as Markdown, one directory for each document."""
    write_listing(markdown_lines(items), path)


def layout_documents(items: DataFrame) -> DataFrame:
    """doc_id and line: each document's layout items as the JSON that sources.readers.layout_json reads."""
    box = F.struct(F.lit(0.0).alias("l"), F.col("bbox_height").alias("t"), F.lit(0.0).alias("r"), F.lit(0.0).alias("b"))
    place = F.struct("page_no", box.alias("bbox"), F.array("charspan.start", "charspan.end").alias("charspan"))
    text = F.struct("seq", "label", "text", F.when(F.col("has_prov"), F.array(place)).otherwise(F.array().cast("array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>,charspan:array<int>>>")).alias("prov"))
    # a document's own items are gathered, as they are one document of JSON
    rows = items.filter("item_kind = 'text'").groupBy("doc_id").agg(F.sort_array(F.collect_list(text)).alias("t"))
    texts = F.transform("t", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), x["prov"].alias("prov")))
    return rows.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("name"), texts.alias("texts"))).alias("line"))


def write_pages(items: DataFrame, path: str, start: int, end: int) -> None:
    """The pages start to end of each document as converted documents of their own; a range outside a document is an error."""
    layout_documents(layout.page_slice(items, start, end)).write.partitionBy("doc_id").text(path)


def observed(paragraphs: DataFrame, name: str = "paragraphs") -> tuple[DataFrame, Observation]:
    """The frame, and an observation that holds its counts once it has been written: progress without a second pass."""
    watch = Observation(name)
    pages = F.approx_count_distinct(F.struct("doc_id", F.element_at("meta", F.lit("page_#"))))
    return paragraphs.observe(watch, F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("characters"), pages.alias("pages")), watch


def page_progress(paragraphs: DataFrame, verbose: bool = False) -> DataFrame:
    """doc_id, section_no, para_no, page: where a report of progress is due. That is each paragraph on another page than the
    one before if verbose, else the first paragraph and those beyond each tenth page. Pages that are no numbers are passed over."""
    page = F.element_at("meta", F.lit("page_#"))
    df = paragraphs.select("doc_id", "section_no", "para_no", page.try_cast("int").alias("page")).filter("page is not null")
    order = W.partitionBy("doc_id").orderBy("section_no", "para_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    if verbose:
        df = df.withColumn("seen", F.lag("page").over(order)).filter(F.coalesce(F.col("page") != F.col("seen"), F.lit(True)))
    else:
        tens = F.floor(F.col("page") / 10)
        df = df.withColumn("seen", F.coalesce(F.max(tens).over(before), F.lit(-1))).filter(tens > F.col("seen"))
    return df.drop("seen")


def outline(value, indent: int = 0) -> Iterator[str]:
    """Lines of nested dicts and lists, for looking at intermediate results."""
    pad = "  " * indent
    if isinstance(value, (dict, list, tuple)):
        for key, inner in value.items() if isinstance(value, dict) else enumerate(value):
            if isinstance(inner, (dict, list, tuple)):
                yield f"{pad}{key}:"
                yield from outline(inner, indent + 1)
            else:
                yield f"{pad}{key}: {inner}"
    else:
        yield f"{pad}{value}"
