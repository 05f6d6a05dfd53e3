"""Command line: python -m quirefold.cli FILE | --text TEXT"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import SparkSession

from quirefold.api import Converter
from quirefold.operators import cleaner as L
from quirefold.operators import speech
from quirefold.sources import sinks


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quirefold")
    p.add_argument("file_path", nargs="?")
    for flag in ("--text", "--output-file", "--instruct", "--lexicon"):
        p.add_argument(flag)
    p.add_argument("--llm-model", default=L.MODEL)
    p.add_argument("--llm-url", default=L.CHAT_URL)
    for flag in ("--start-page", "--end-page"):
        p.add_argument(flag, type=int)
    for flag in ("--dry-run", "--generate-text-file", "--llm-cleaner", "--verbose"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--sections-to-skip", nargs="*", default=[])
    p.add_argument("--engine", choices=["tone", "kokoro", "qwen"], default="kokoro")
    p.add_argument("--voice", default="af_heart")
    p.add_argument("--speaker", default="vivian")
    p.add_argument("--language", default="English")
    p.add_argument("--model-size", default="0.6b")
    return p


def engine(args: argparse.Namespace):
    """A factory: engines are made where they are used."""
    if args.engine == "tone":
        return speech.ToneEngine
    if args.engine == "qwen":
        return partial(speech.VoiceEngine, speaker=args.speaker, language=args.language, instruct=args.instruct or "", model_size=args.model_size)
    return partial(speech.SegmentEngine, voice=args.voice)


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    if not args.text and not args.file_path:
        raise ValueError("give a file or --text")
    if args.llm_cleaner and not args.lexicon:
        raise ValueError("--llm-cleaner needs --lexicon, the path of a word list")
    spark = SparkSession.builder.appName("quirefold").getOrCreate()
    cleaner = L.by_name(spark, args.llm_model, args.lexicon, args.llm_url) if args.llm_cleaner else None
    run = Converter(spark, engine(args), args.dry_run, cleaner=cleaner)
    if args.text:
        out = run.convert(args.text, args.output_file, is_text=True)
    else:
        out = run.convert(args.file_path, args.output_file, generate_text_file=args.generate_text_file, start_page=args.start_page, end_page=args.end_page, sections_to_skip=args.sections_to_skip)
    if args.verbose or args.dry_run:
        for row in out.orderBy("section_no", "para_no").toLocalIterator():
            print(row["text"], end="\n\n")
    if not args.text:
        for row in sinks.page_progress(out, args.verbose).orderBy("section_no", "para_no").toLocalIterator():
            print(f"  [Page {row['page']}]")
    if args.verbose and cleaner and cleaner.timing:
        print(L.timing_line(cleaner.timing))


if __name__ == "__main__":
    main()
