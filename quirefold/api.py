"""Facade: a source in, paragraphs and optionally audio out."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quirefold.operators import cleaner as L
from quirefold.operators import html_sections, layout, speech
from quirefold.operators import paragraphs as P
from quirefold.sources import readers, sinks

MIN_SIZE = 5


def parse(spark: SparkSession, path: str, min_size: int = MIN_SIZE, include_footnotes: bool = False, start_page: int | None = None, end_page: int | None = None,
          sections_to_skip: list[str] | None = None, rules=None, cleaner=None, convert=None, meta: dict[str, str] | None = None, lexicon: str | None = None, llm_url: str = L.CHAT_URL) -> DataFrame:
    """Paragraphs of a file or of all files that a path names: doc_id, section_no, para_no, text, label, meta. cleaner is an
    operators.cleaner.Cleaner, or the name of a model that the service at llm_url serves; that needs a lexicon, the path of
    a word list."""
    cleaner = L.by_name(spark, cleaner, lexicon, llm_url) if isinstance(cleaner, str) else cleaner
    suffix = readers.is_source(path)
    if suffix == ".txt":
        return readers.text_files(spark, path).drop("path")
    if suffix == ".epub":
        items = readers.epub_files(spark, path)
        skip = items.select("book_title", "item_id").filter(items["item_id"].isin(sections_to_skip)) if sections_to_skip else None
        return P.paragraphs(html_sections.to_chunks(items, skip, meta), min_size, rules=rules, cleaner=cleaner)
    items = readers.layout_json(spark, path) if suffix == ".json" else readers.converted(spark, path, str(Path(path).with_suffix(".items")), convert)
    chunks = layout.to_chunks(layout.classified(items), include_footnotes, start_page, end_page, meta)
    return P.paragraphs(chunks, min_size, include_footnotes, rules=rules, cleaner=cleaner)


def lists(paragraphs: DataFrame) -> tuple[list[str], list[dict[str, str]]]:
    """Texts and metas of one document, in order, as parallel lists."""
    rows = paragraphs.orderBy("section_no", "para_no").collect()
    return [r["text"] for r in rows], [r["meta"] for r in rows]


class Converter:
    """Source to audio. dry_run stops after the paragraphs."""

    def __init__(self, spark: SparkSession, engine: Callable[[], speech.Engine], dry_run: bool = False, **parsing):
        self.spark, self.engine, self.dry_run, self.parsing = spark, engine, dry_run, parsing

    def convert(self, source: str, output_file: str | None = None, is_text: bool = False, generate_text_file: bool = False, **parsing) -> DataFrame:
        """The paragraphs; the audio goes to output_file, or beside the source."""
        if is_text:
            from quirefold.operators.chunks import from_strings

            out = from_strings(self.spark, [source]).withColumnRenamed("seq", "para_no")
            target = output_file or "output.wav"
        else:
            if not source:
                raise ValueError("no input")
            if not readers.exists(self.spark, source):
                raise FileNotFoundError(source)
            out = parse(self.spark, source, **self.parsing | parsing)
            target = output_file or str(Path(source).with_suffix(".wav"))
            if generate_text_file:
                base = str(Path(source).with_suffix(""))
                sinks.listing_file(sinks.paragraph_lines(out), base + "_processed_paragraphs.txt")
                sinks.listing_file(sinks.meta_lines(out), base + "_processed_meta.txt")
        if not self.dry_run and out.limit(1).count():
            sinks.wav_file(speech.in_order(speech.synthesised(out, self.engine)), target)
        return out
