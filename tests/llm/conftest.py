from __future__ import annotations

import random

import pytest

#: Column names that operators use inside: a table may have them as well.
CLASHING = "block long, loc_row long, loc_file string, held boolean, class string, token string, digest string, keep string, rest string, n long, id long, norm string, sha string, text_sha256 string, gone_id long, salt long, kept boolean"
EXTRA = (7, 7, "f", True, "c", "t", "d", "k", "r", 7, 7, "m", "s", "h", 7, 7, False)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

SYLLABLES = "the tion ing er an re on at en nd ti es or te of ed is it al ar st to nt ha".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with exact and near copies, shared passages, and the odd cases: null, empty, blank, signs, long, repeated."""
    rng = random.Random(11)
    passage = words(rng, 60)
    base = [words(rng, rng.randint(3, 220)) for _ in range(60)]
    texts = list(base)
    for t in base[:25]:
        w = t.split()
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += [t.upper() if k % 2 else t for k, t in enumerate(base[10:20])]
    texts += [words(rng, 30) + " " + passage + "\n" + words(rng, 20) for _ in range(12)]
    texts += [None, "", "", " \t\n", "?!  ... 12", "one", "one two", "one two three four five", "über façade naïve " * 12, "漢字かな" * 30, "🙂🙂", "a" * 30_000, "x y " * 4_000, "Licensed under CC BY-NC 4.0.", "<|endoftext|> the"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[i], "en" if i % 3 else "fr", f"s{i % 4}", len(texts[i] or "")) for i in order]
    rows += [rows[0], rows[1]]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data") / "documents.parquet")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, and columns with names that operators use inside."""
    rows = [(1, "some text that is here", None, None, None, *EXTRA), (None, "some text that is here", "en", "s", 5, *EXTRA), (2, None, "en", "s", 0, *([None] * len(EXTRA))), (None, None, None, None, None, *([None] * len(EXTRA))), (3, "the other text", "en", "s", 3, *EXTRA)]
    path = str(tmp_path_factory.mktemp("data") / "odd.parquet")
    spark.createDataFrame(rows, f"{DOCS}, {CLASHING}").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"{DOCS}, {CLASHING}")
