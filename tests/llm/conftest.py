import random
import uuid

import pytest

LONG = ("the of and a to in " * 3 + "wordy text goes on and on, line by line.\n") * 900
EXTRA = "id bigint, score double, text_key bigint, lost string, held_out string, h int"


def made_documents(seed=7, n=60):
    """Rows (doc_id, text, lang, source, n_chars, extra columns): copies, near copies, repeated lines and passages,
    nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    common = [sentence(9) for _ in range(4)]
    passage = sentence(120)
    texts = []
    for k in range(n):
        kind = k % 10
        if kind == 1:
            texts.append(texts[-1])
        elif kind == 2:
            cut = texts[-1].split(" ")
            for _ in range(max(1, len(cut) // 60)):
                cut[rng.randrange(len(cut))] = rng.choice(words)
            texts.append(" ".join(cut))
        elif kind == 3:
            texts.append("\n".join([rng.choice(common), sentence(12), f"  {rng.choice(common).upper()}\t", sentence(5)]))
        elif kind == 4:
            texts.append(sentence(rng.randint(1, 30)) + " " + passage + " " + sentence(rng.randint(1, 30)))
        elif kind == 5:
            texts.append(" ".join([rng.choice(words)] * rng.randint(1, 300)))
        elif kind == 6:
            texts.append(sentence(rng.randint(1, 3)))
        else:
            texts.append("\n".join(sentence(rng.randint(3, 25)) for _ in range(rng.randint(1, 12))))
    texts += ["", None, " \t\n ", "12 34 !!", "\n\n\n", LONG, LONG + "end", "x" * 5000, "漢字 🙂 ñ \u0000 end", "'s 're I'll  go there now"]
    rows = [(k, t, rng.choice(["en", "fr", None]), "src0", None, k, 0.5, k, "z", "y", 1) for k, t in enumerate(texts)]
    rows += [rows[0], rows[11], (None, None, None, None, None, None, None, None, None, None, None), (None, texts[0], "en", None, 1, None, None, None, None, None, None)]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + EXTRA


@pytest.fixture(scope="session")
def rows():
    return made_documents()


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory, rows):
    """A folder of small tables as the queries read them."""
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    ids = [r[0] for r in rows if r[0] is not None]
    labels = [(i, int(i % 10 != 5), 0, 1.0) for i in ids] + [(ids[0], 0, 0, None), (None, 1, 0, None), (10_000, 1, None, None), (3, None, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score double").write.parquet(f"{out}/labels.parquet")
    items = [(0, rows[4][1][:300], 1), (1, rows[7][1], 2), (2, None, None), (3, "", 1), (4, "two words", 1), (None, rows[0][1], 4), (5, rows[4][1][:300], 5)]
    spark.createDataFrame(items, "item_id bigint, text string, doc_id int").write.parquet(f"{out}/benchmark.parquet")
    turns = [(1, t, ("system", "user", "assistant")[min(t, 1 + t % 2)], f"turn {t}\n\"q\" é") for t in range(40)]
    turns += [(2, 0, "user", None), (2, 1, "assistant", ""), (2, 3, "assistant", "orphan"), (3, 0, "user", ""), (3, 0, "user", "twice"), (3, 0, "user", "twice"), (None, 1, None, "x"), (4, None, "user", "y"), (5, 2, "tool", "z")]
    spark.createDataFrame([(*t, 1, "n") for t in turns], "conv_id bigint, turn bigint, role string, text string, level int, name string").write.parquet(f"{out}/conversations.parquet")
    return out


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """The same tables without rows."""
    out = str(tmp_path_factory.mktemp("none"))
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string"), ("conversations", "conv_id bigint, turn bigint, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture
def written_documents(spark, tmp_path):
    """Writes rows (doc_id, text) as a table folder."""

    def write(rows, parts=3):
        out = f"{tmp_path}/{uuid.uuid4().hex}"
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts).write.parquet(f"{out}/documents.parquet")
        return out

    return write
