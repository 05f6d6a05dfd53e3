"""Sources: text files, raw strings, EPUB archives, converted layouts, side lists and lexicons.

Everything goes through Spark's readers, so a path may be on any file system that Spark knows.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import text as T
from quirefold.operators.layout import ITEM

#: Bytes that one row group of a Parquet file holds, as it is usually written.
ROW_GROUP = 128 << 20


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. A file of one row group is one task, whatever its rows cost; so a table of fewer files than there are
    cores, and of no more bytes than one row group a file, is dealt out to the cores. Larger tables are read as they are."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= cores * ROW_GROUP:
        files = len(df.inputFiles())
        if files < cores and df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= files * ROW_GROUP:
            return df.repartition(cores)
    return df


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one paragraph, as it is: path, doc_id, section_no, para_no, text, label, meta."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return df.select("path", F.xxhash64("path").alias("doc_id"), F.lit(0).alias("section_no"), F.lit(1).alias("para_no"), "text", F.lit("text").alias("label"), F.create_map().cast("map<string,string>").alias("meta"))


def epub_documents(data: bytes) -> tuple[str, list[tuple[str, str]]]:
    """Title, and id and HTML of the documents of an EPUB archive, in the order of its manifest."""
    ns = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf", "d": "http://purl.org/dc/elements/1.1/"}
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        package = ElementTree.fromstring(archive.read("META-INF/container.xml")).find(".//c:rootfile", ns).get("full-path")
        tree = ElementTree.fromstring(archive.read(package))
        title = tree.findtext(".//d:title", default="", namespaces=ns)
        names = set(archive.namelist())
        out = []
        for item in tree.iterfind(".//o:manifest/o:item", ns):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(package), item.get("href")))
            if item.get("media-type") in ("application/xhtml+xml", "text/html") and name in names:
                out.append((item.get("id"), archive.read(name).decode("utf-8", "replace")))
    return title, out


def epub_files(spark: SparkSession, path: str) -> DataFrame:
    """book_id, book_title, item_seq, item_id, html of all documents of the archives at the path."""
    from quirefold.operators.html_sections import body_html

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"], strict=True):
                title, items = epub_documents(bytes(content))
                yield pd.DataFrame({"path": path_, "book_title": title, "item_seq": range(len(items)), "item_id": [i for i, _ in items], "html": [h for _, h in items]}).astype({"item_seq": "int32"})

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, book_title string, item_seq int, item_id string, html string")
    return raw.select(F.xxhash64("path").alias("book_id"), "book_title", "item_seq", "item_id", body_html(F.col("html")).alias("html"))


_LAYOUT = """name string, texts array<struct<label:string, text:string, prov:array<struct<page_no:int, bbox:struct<l:double,t:double,r:double,b:double>,
    charspan:array<int>>>>>"""


def layout_json(spark: SparkSession, path: str) -> DataFrame:
    """Layout items of converted documents stored as JSON, one document a file."""
    df = spark.read.schema(_LAYOUT).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "texts")
    item = df.select(F.xxhash64("path").alias("doc_id"), F.posexplode("texts").alias("seq", "t"))
    first = F.get("t.prov", F.lit(0))
    span = F.struct(F.get(first["charspan"], F.lit(0)).alias("start"), F.get(first["charspan"], F.lit(1)).alias("end"))
    return item.select("doc_id", "seq", F.lit("text").alias("item_kind"), F.col("t.label").alias("label"), F.col("t.text").alias("text"), first.isNotNull().alias("has_prov"),
                       first["page_no"].alias("page_no"), F.abs(first["bbox"]["t"] - first["bbox"]["b"]).alias("bbox_height"), span.alias("charspan"))


def converted(spark: SparkSession, path: str, cache: str, convert: Callable[[bytes], pd.DataFrame] | None = None) -> DataFrame:
    """Layout items of binary documents by a converter, read from the cache if it is there and written to it if not.
    convert gives the item columns without doc_id."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        if convert is None:
            raise ValueError("no cache and no converter")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                    yield convert(bytes(content)).assign(doc_id=doc_id)[[x.split()[0] for x in ITEM.split(", ")]]

        files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "content")
        files.mapInPandas(run, ITEM).write.mode("ignore").parquet(cache)
    return spark.read.parquet(cache)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _strip(name: str):
    return T.stripped(F.coalesce(F.col(name), F.lit("")))


def sections_to_skip(spark: SparkSession, path: str) -> DataFrame:
    """book_title and item_id of a CSV with the columns Book Title and Section Title; no file is an empty list."""
    if not exists(spark, path):
        return spark.createDataFrame([], "book_title string, item_id string")
    df = spark.read.csv(path, schema="`Book Title` string, `Section Title` string", header=True, multiLine=True, escape='"')
    return skip_list(df.select(F.col("Book Title").alias("book_title"), F.col("Section Title").alias("item_id")))


def skip_list(rows: DataFrame) -> DataFrame:
    return rows.select(_strip("book_title").alias("book_title"), _strip("item_id").alias("item_id")).filter("book_title <> '' AND item_id <> ''").distinct()


def valid_pages(spark: SparkSession, path: str) -> DataFrame:
    """book_title, first_page and last_page of a CSV with the columns Book Title, Start and End; of several rows with a
    title the last counts, and a page that is no number is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], "book_title string, first_page int, last_page int")
    df = spark.read.csv(path, schema="`Book Title` string, Start string, End string", header=True, multiLine=True, escape='"')
    return page_ranges(df.select(F.col("Book Title").alias("book_title"), F.col("Start").alias("first_page"), F.col("End").alias("last_page"), F.monotonically_increasing_id().alias("row_no")))


def page_ranges(rows: DataFrame) -> DataFrame:
    """rows: book_title, first_page, last_page as strings, and row_no."""
    df = rows.select(*(_strip(c).alias(c) for c in ("book_title", "first_page", "last_page")), "row_no").filter("book_title <> '' AND first_page <> '' AND last_page <> ''")
    number = lambda c: F.when(F.col(c).rlike(r"^[+-]?\d+$"), F.col(c).try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("no page number: "), F.col(c))).cast("int")).alias(c)
    df = df.select("book_title", number("first_page"), number("last_page"), "row_no")
    return df.groupBy("book_title").agg(F.max_by(F.struct("first_page", "last_page"), "row_no").alias("r")).select("book_title", "r.*")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words of a word list, one word a line."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).filter("word <> ''").distinct()


def is_source(path: str) -> str:
    """The suffix of a file that can be converted; anything else is an error."""
    suffix = Path(path).suffix.lower()
    if suffix not in (".txt", ".epub", ".pdf", ".json"):
        raise ValueError(f"unsupported file type: {suffix or path}")
    return suffix
