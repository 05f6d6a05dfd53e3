import json
import wave
import zipfile

import numpy as np
import pytest

from quirefold import api
from quirefold.cli import arguments, engine, main
from quirefold.operators import compare, speech
from quirefold.operators.layout import ITEM
from quirefold.sources import readers, sinks


def test_lists(spark, tmp_path):
    path = tmp_path / "skip.csv"
    path.write_text('Book Title,Section Title\n A , s1 \nA,s1\n,s2\nB,\n"C, D",s3\n')
    assert {tuple(r) for r in readers.sections_to_skip(spark, str(path)).collect()} == {("A", "s1"), ("C, D", "s3")}
    assert readers.sections_to_skip(spark, str(tmp_path / "none.csv")).count() == 0
    path.write_text("Book Title,Start,End\nA,1,5\nB,2,\n A ,3,9\n")
    assert [tuple(r) for r in readers.valid_pages(spark, str(path)).collect()] == [("A", 3, 9)]
    path.write_text("Book Title,Start,End\nA,x,5\n")
    with pytest.raises(Exception, match="no page number"):
        readers.valid_pages(spark, str(path)).collect()


def test_lexicon(spark, tmp_path):
    (tmp_path / "w.txt").write_text("Dog\ncat\ndog\n\n")
    assert {r.word for r in readers.lexicon(spark, str(tmp_path / "w.txt")).collect()} == {"dog", "cat"}


def make_epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>My Book</dc:title></metadata><manifest>'
                   '<item id="c1" href="a.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/><item id="c2" href="b.xhtml" media-type="application/xhtml+xml"/></manifest></package>')  # fmt: skip
        z.writestr("O/a.xhtml", "<html><body><h1>ONE</h1><p>First text of the first chapter.</p></body></html>")
        z.writestr("O/b.xhtml", "<html><body><p>Second text of the book.</p></body></html>")


def test_epub(spark, tmp_path):
    path = tmp_path / "b.epub"
    make_epub(path)
    texts, metas = api.lists(api.parse(spark, str(path)))
    assert texts == ["One", "One", "First text of the first chapter.", "Second text of the book."]
    assert metas[3] == {"book_title": "My Book", "item_id": "c2", "item_#": "2", "paragraph_#": "1"}
    assert api.lists(api.parse(spark, str(path), sections_to_skip=["c1"]))[1][0]["item_#"] == "1"


def test_layout_json(spark, tmp_path):
    path = tmp_path / "d.json"
    item = lambda label, text, page, h: {"label": label, "text": text, "prov": [{"page_no": page, "bbox": {"l": 0, "t": h, "r": 1, "b": 0}, "charspan": [0, len(text)]}]}
    path.write_text(json.dumps({"name": "d", "texts": [item("page_header", "Head", 1, 10), item("text", "A first sentence.", 1, 10), item("text", "On page two.", 2, 10), {"label": "footnote", "text": "1 Note text.", "prov": item("x", "y", 2, 1)["prov"]}]}))
    assert api.lists(api.parse(spark, str(path)))[0] == ["A first sentence.", "On page two."]
    assert api.lists(api.parse(spark, str(path), include_footnotes=True, start_page=2))[0] == ["On page two.", "1 Note text."]


def test_text_and_audio(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("Some  text .\nMore.")
    run = api.Converter(spark, speech.ToneEngine)
    out = run.convert(str(path), generate_text_file=True)
    assert api.lists(out) == (["Some  text .\nMore."], [{}])
    with wave.open(str(tmp_path / "t.wav")) as f:
        assert (f.getframerate(), f.getnframes()) == (24000, 24 * len("Some  text .\nMore."))
    assert (tmp_path / "t_processed_paragraphs.txt").read_text() == "Some  text .\nMore.\n\n"
    assert (tmp_path / "t_processed_meta.txt").read_text() == "[]\nSome  text .\nMore.\n\n"
    run.convert("Say this", str(tmp_path / "s.wav"), is_text=True)
    assert (tmp_path / "s.wav").exists()
    api.Converter(spark, speech.ToneEngine, dry_run=True).convert("x", str(tmp_path / "no.wav"), is_text=True)
    assert not (tmp_path / "no.wav").exists()


def test_refusals(spark, tmp_path):
    run = api.Converter(spark, speech.ToneEngine)
    with pytest.raises(ValueError):
        run.convert("")
    with pytest.raises(FileNotFoundError):
        run.convert(str(tmp_path / "none.txt"))
    (tmp_path / "x.doc").write_text("x")
    with pytest.raises(ValueError):
        run.convert(str(tmp_path / "x.doc"))
    with pytest.raises(ValueError):
        sinks.listing_file(spark.range(1), None)
    with pytest.raises(ValueError):
        main([])


def test_audio_order(spark):
    rows = [(1, 0, 2, "bb"), (1, 0, 1, "a"), (1, 1, 1, "ccc")]
    df = spark.createDataFrame(rows, "doc_id long, section_no int, para_no int, text string")
    pcm = b"".join(r.pcm for r in speech.in_order(speech.synthesised(df, speech.ToneEngine)).orderBy("part").collect())
    tone = speech.ToneEngine()
    assert bytes(pcm) == b"".join(speech.pcm(tone.generate(t)) for t in ("a", "bb", "ccc"))
    assert [r.text for r in speech.segments(df.withColumn("text", df.text.cast("string"))).collect()]


def test_wav_files(spark, tmp_path):
    rows = [(d, 0, k, "ab" * (d + k)) for d in (1, 2, 3) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, section_no int, para_no int, text string")
    out = sinks.wav_files(speech.in_order(speech.synthesised(df, speech.ToneEngine)), str(tmp_path / "wav")).collect()
    for r in out:
        with wave.open(r.path) as f:
            assert (f.getframerate(), f.getnchannels(), f.getsampwidth()) == (24_000, 1, 2)
            whole = f.readframes(f.getnframes())
        tone = speech.ToneEngine()
        assert whole == b"".join(speech.pcm(tone.generate("ab" * (r.doc_id + k))) for k in range(5))
        assert len(whole) == r.n_bytes
    assert sorted(x.name for x in (tmp_path / "wav").iterdir()) == ["1.wav", "2.wav", "3.wav"]


def test_engines():
    seen = {}

    def pipeline(text, voice, speed, split_pattern):
        seen.update(voice=voice, speed=speed)
        return [("", "", np.ones(2)), ("", "", np.zeros(1))]

    assert speech.SegmentEngine(pipeline).generate("x").tolist() == [1, 1, 0]
    assert seen == {"voice": "af_heart", "speed": 1.0}

    class Model:
        def generate_custom_voice(self, **said):
            return [np.ones(3)], 16000

    own = speech.VoiceEngine(model=Model())
    assert len(own.generate("x")) == 3
    assert own.sample_rate == 16000
    assert isinstance(engine(arguments().parse_args(["--engine", "tone"]))(), speech.ToneEngine)


def test_cache(spark, tmp_path):
    import pandas as pd

    (tmp_path / "a.pdf").write_bytes(b"pdf")
    calls = tmp_path / "calls"
    calls.mkdir()

    def convert(data):
        (calls / str(len(list(calls.iterdir())))).touch()
        return pd.DataFrame([{"seq": 0, "item_kind": "text", "label": "text", "text": "Converted text.", "has_prov": True, "page_no": 1, "bbox_height": 10.0, "charspan": {"start": 0, "end": 15}}])

    for _ in range(2):
        assert api.lists(api.parse(spark, str(tmp_path / "a.pdf"), convert=convert))[0] == ["Converted text."]
    assert len(list(calls.iterdir())) == 1
    with pytest.raises(ValueError):
        readers.converted(spark, "x", str(tmp_path / "none"))


def test_compare(spark):
    left = spark.createDataFrame([(1, 1, "Colour it."), (1, 2, "same"), (1, 3, "gone words")], "doc_id long, line_no int, line string")
    right = spark.createDataFrame([(1, 1, "Color it!"), (1, 2, "SAME."), (1, 4, "new")], "doc_id long, line_no int, line string")
    assert {r.line_no for r in compare.differing_lines(left, right).collect()} == {3, 4}


def test_variants(spark):
    pairs = {("initialize", "initialise"): True, ("centre", "center"): True, ("programme", "program"): True, ("colour", "color"): True, ("text", "footnote"): False, ("cat", "car"): False, ("test", "text"): False, ("a", ""): False, ("", ""): True}
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, p string, q string")
    assert [r[1] for r in df.select("k", compare.are_variants(df.p, df.q)).orderBy("k").collect()] == [*pairs.values()]


def test_listing(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 2, "b", {"k": "v", "a": "z"}), (1, 0, 1, "a", {})], "doc_id long, section_no int, para_no int, text string, meta map<string,string>")
    sinks.write_listing(sinks.meta_lines(df), str(tmp_path / "out"))
    (part,) = (tmp_path / "out" / "doc_id=1").glob("part-*")
    assert part.read_text() == "[]\na\n\n[a: z | k: v]\nb\n\n"


def test_watching(spark):
    df = spark.createDataFrame([(1, "abc", {"page_#": "1"}), (1, "de", {"page_#": "2"})], "doc_id long, text string, meta map<string,string>")
    out, watch = sinks.observed(df)
    out.write.format("noop").mode("overwrite").save()
    assert watch.get == {"paragraphs": 2, "characters": 5, "pages": 2}
    assert list(sinks.outline({"a": [1, {"b": 2}], "c": "d"})) == ["a:", "  0: 1", "  1:", "    b: 2", "c: d"]


def test_page_progress(spark):
    pages = ["1", "2", "2", "iv", "9", "11", "12", "25", "19", None, "30"]
    rows = [(1, 0, k, {} if p is None else {"page_#": p}) for k, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "doc_id long, section_no int, para_no int, meta map<string,string>")
    at = lambda verbose: [r.page for r in sinks.page_progress(df, verbose).orderBy("para_no").collect()]
    assert at(False) == [1, 11, 25, 30]
    assert at(True) == [1, 2, 9, 11, 12, 25, 19, 30]


def test_cleaner_from_the_command_line(spark, tmp_path, capsys):
    """A service on this machine answers chat messages; the model is named on the command line."""
    import http.server
    import json
    import threading

    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(asked["model"])
            text = asked["messages"][1]["content"].rsplit("\n", 1)[1]
            said = json.dumps({"choices": [{"message": {"content": json.dumps({"cleaned": text.replace("wrng", "wrong"), "classification": "body"})}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        (tmp_path / "words.txt").write_text("this\nis\nwrong\nright\n")
        page = {"page_no": 1, "bbox": {"l": 0, "t": 10, "r": 1, "b": 0}, "charspan": [0, 14]}
        (tmp_path / "b.json").write_text(json.dumps({"name": "b", "texts": [{"label": "text", "text": t, "prov": [page]} for t in ("This is wrng.", "This is right.")]}))
        url = f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
        main([str(tmp_path / "b.json"), "--dry-run", "--verbose", "--engine", "tone", "--llm-cleaner", "--llm-model", "own", "--llm-url", url, "--lexicon", str(tmp_path / "words.txt")])
    finally:
        server.shutdown()
    out = capsys.readouterr().out
    assert "This is wrong." in out
    assert "This is right." in out
    assert "(1 skipped)" in out
    assert "(1 calls)" in out
    assert seen == ["own"]
    with pytest.raises(ValueError):
        main(["x.json", "--llm-cleaner"])


def test_pages_as_documents(spark, tmp_path):
    """A slice of a converted document is a converted document."""
    rows = [(1, k, "text" if k != 3 else "other", "list_item" if k % 2 else "text", f"text {k} é", k != 4, 1 + k // 3, 8.0 + k, (0, 5 + k)) for k in range(12)]
    items = spark.createDataFrame(rows, ITEM)
    sinks.write_pages(items, str(tmp_path / "out"), 2, 3)
    back = readers.layout_json(spark, str(tmp_path / "out" / "doc_id=1")).orderBy("seq").collect()
    wanted = [r for r in rows if r[2] == "text" and r[6] in (2, 3)]
    assert [(r.label, r.text, r.has_prov) for r in back] == [(r[3], r[4], r[5]) for r in wanted]
    assert [(r.page_no, r.bbox_height, tuple(r.charspan)) for r in back if r.has_prov] == [(r[6], r[7], r[8]) for r in wanted if r[5]]
    with pytest.raises(Exception, match="invalid page range"):
        sinks.write_pages(items, str(tmp_path / "none"), 2, 9)
    sinks.write_markdown(items, str(tmp_path / "md"))
    assert "- text 1 é" in next((tmp_path / "md" / "doc_id=1").glob("part-*")).read_text()
