import itertools
import random

import pytest

#: columns whose names the operators use themselves
CLASH = ["lang_pred", "score", "kept", "text2", "id", "key", "th", "list", "path", "host", "band", "bucket", "class_id", "next_text", "fingerprint", "shard", "n_bytes"]


@pytest.fixture(scope="session")
def make(spark):
    """make(texts, null_id=False): documents with an id, a text, other columns and clashing names."""

    def build(texts, ids=None, langs=None, parts=3):
        ids = list(range(len(texts))) if ids is None else ids
        langs = langs or [None] * len(texts)
        rows = [(i, t, lang, None, None if t is None else len(t), *([f"c{k}"] * len(CLASH))) for k, (i, t, lang) in enumerate(zip(ids, texts, langs))]
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
        return spark.createDataFrame(rows, schema).repartition(parts)

    return build


@pytest.fixture(scope="session")
def edges():
    """Texts at the edges: null, empty, blank, one word, long, repeated, other scripts."""
    r = random.Random(9)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(999)) for _ in range(30_000))
    return [None, "", "   \n\t ", "word", "word", "!!! ???", "日本語 テキスト", "é" * 3000, "a\x00b", long, "x" * 5000, "same line\nsame line\nsame line", *itertools.repeat("twice " * 60, 2)]
