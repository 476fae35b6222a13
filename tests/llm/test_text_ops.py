"""Operators that judge, score or encode texts one by one."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from idweave.llm import bpe_codec, common, html_extraction, language_id, quality_classifier, quality_rules, url_filters

SF = "/root/testdata/sf0.001"


def vocabulary_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- helpers


def test_words_and_hashes_do_not_cross_rows():
    texts = ["a b", "", "b", " a\u00a0b \x0bc", None, "\n"]
    data, offsets, null = common.utf8_view(pa.array(texts).slice(0))
    start, end, row = common.words(data, offsets)
    found = [[bytes(data[a:b]).decode() for a, b, r in zip(start, end, row) if r == k] for k in range(len(texts))]
    assert found == [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts] and null.tolist() == [t is None for t in texts]
    sliced = common.utf8_view(pa.array(texts).slice(2, 2))
    assert bytes(sliced[0][sliced[1][0] : sliced[1][1]]) == b"b"


def test_packed_arrays_come_back():
    arrays = {"a": np.arange(7), "b": np.zeros((2, 3), np.float32), "c": np.zeros(0, np.uint8)}
    back = common.unpacked(common.packed(arrays))
    assert all((back[k] == v).all() and back[k].dtype == v.dtype for k, v in arrays.items())


# ---------------------------------------------------------------- language


def test_language_accuracy_and_edges(spark, make, edges):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    out = language_id.detect_language(docs, model, keep=["lang"]).withColumn("held_out", language_id.held_out())
    held = out.filter("held_out")
    assert out.count() == docs.count() and held.filter("lang_pred = lang").count() >= 0.97 * held.count()
    rows = {r.doc_id: r for r in language_id.detect_language(make(edges), model).collect()}
    assert len(rows) == len(edges) and all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[k].lang_pred for k in (0, 1, 2, 5)] == ["und"] * 4 and rows[3].lang_pred == rows[4].lang_pred != "und"
    kept = language_id.keep_identified(make(edges), model)
    assert kept.columns == make(edges).columns and {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 5})
    assert language_id.detect_language(docs.limit(0), model).count() == 0
    unlabelled = language_id.fit(make(["some text"] * 3))
    assert {r.lang_pred for r in language_id.detect_language(make(edges), unlabelled).collect()} == {"und"}


def test_network_against_plain_loops():
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (40, language_id.WINDOW)).astype(np.uint8)
    windows[3, 50:] = 0
    net = language_id.train(windows, rng.integers(0, 3, 40), 3, epochs=1)
    got = np.exp(language_id.log_probabilities(windows, net))
    widths = [w for w, n in language_id.FILTERS.items() for _ in range(n)]
    for window, p in zip(windows.tolist(), got):
        padded = window + [0] * (max(widths) - 1)
        hidden = []
        for f, width in enumerate(widths):
            weights = net["filters"][:, f].reshape(-1, language_id.DIM).astype(float)
            assert not weights[width:].any()
            best = max(sum(float(net["embedding"][padded[at + k]] @ weights[k]) for k in range(width)) for at in range(len(window)))
            hidden.append(max(best + float(net["bias"][f]), 0.0))
        z = [sum(h * float(o) for h, o in zip(hidden, net["out"][:, c])) + float(net["out_bias"][c]) for c in range(3)]
        e = [np.exp(x - max(z)) for x in z]
        assert np.allclose(p, np.array(e) / sum(e), atol=1e-4)
    # a document: the mean of its windows' distributions, weighted by their bytes
    text = "".join(chr(rng.integers(97, 123)) for _ in range(400))
    raw = np.frombuffer(text.encode(), np.uint8)
    parts = [raw[a : a + language_id.WINDOW] for a in range(0, len(raw), language_id.WINDOW)]
    full = np.array([np.pad(x, (0, language_id.WINDOW - len(x))) for x in parts])
    wanted = sum(len(x) * q for x, q in zip(parts, np.exp(language_id.log_probabilities(full, net)))) / len(raw)
    assert np.allclose(language_id.classify(pa.array([text, ""]), net)[0], wanted, atol=1e-5)


def test_every_language_is_sampled(make):
    langs = [f"l{k:03d}" for k in range(300)]
    docs = make([f"text in the language number {k} of many" for k in range(300)] + ["null id"] * 5, ids=[*range(300), *[None] * 5], langs=langs + ["l000"] * 5)
    windows, labels, found = language_id.labelled_windows(docs, "doc_id", "text", "lang")
    assert found == langs and len(set(labels.tolist())) == 300


def test_training_is_not_cut_short():
    assert language_id.train.__defaults__[0] == language_id.EPOCHS == 8


def test_windows_cover_every_byte():
    data, offsets, _ = common.utf8_view(pa.array(["x" * 5, "", "y" * 500, "z" * language_id.WINDOW]))
    windows, row, used = language_id.cut_windows(data, offsets)
    assert np.bincount(row, weights=used, minlength=4).tolist() == [5, 0, 500, language_id.WINDOW]
    assert b"".join(bytes(w[:n]) for w, n in zip(windows, used)) == bytes(data)


# ---------------------------------------------------------------- quality rules


def base_by_hand(text):
    text = text or ""
    word = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    times = collections.Counter(zip(word, word[1:], word[2:]))
    covered = {i + k for i in range(len(word) - 2) if times[tuple(word[i : i + 3])] > 1 for k in range(3)}
    return len(word), sum(map(len, word)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("limit", [1 << 20, 700, 50])
def test_base_counts(limit, monkeypatch, edges):
    r = random.Random(2)
    texts = [*edges, *("".join(r.choice(["a ", "b ", "é ", "\n", "x|", "a b c ", "\t", "\u2003"]) for _ in range(r.randint(0, 90))) for _ in range(60))]
    monkeypatch.setattr(quality_rules.text_chunks, "__defaults__", (limit,))
    counts, failed, kept, _ = quality_rules._judge(pa.array(texts), {"ratios": np.zeros(quality_rules.BUCKETS), "cut": [0.0]})
    for k, text in enumerate(texts):
        n = base_by_hand(text)
        assert tuple(counts[:, k]) == n
        assert failed[k] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and kept[k] == (not failed[k])


def test_quality_rules_tell_good_from_bad(spark, make, edges):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality_rules.quality_rules(docs, labels)
    assert out.count() == docs.count()
    judged = out.filter("not base_failed").join(labels, "doc_id")
    for quality, kept in ((1, True), (0, False)):
        part = judged.filter(F.col("quality") == quality)
        assert part.filter(F.col("kept") == kept).count() >= 0.95 * part.count()
    none = quality_rules.quality_rules(make(edges), labels.limit(0))
    assert none.count() == len(edges) and none.filter("kept and base_failed").count() == 0
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.filter("kept").count()


def test_ratio_and_threshold_against_brute_force(spark, make):
    r = random.Random(17)
    good_words, bad_words = [f"g{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    texts = [" ".join(r.choice(good_words if k % 3 else bad_words) if r.random() < 0.8 else r.choice(good_words + bad_words) for _ in range(r.randint(50, 90))) for k in range(60)]
    labels = {k: int(k % 3 > 0) for k in range(40)}
    buckets = {}

    def bucket(words):  # the operator's own hash of a unigram or bigram, the rest is counted here
        if words not in buckets:
            data, offsets, _ = common.utf8_view(pa.array([" ".join(words)]))
            buckets[words] = int(quality_rules._features(data, offsets)[1][-1])
        return buckets[words]

    def grams(text):
        w = text.split()
        return [bucket((x,)) for x in w] + [bucket(pair) for pair in zip(w, w[1:])]

    raw, trusted = collections.Counter(), collections.Counter()
    for k, t in enumerate(texts):
        raw.update(grams(t))
        if labels.get(k) == 1:
            trusted.update(grams(t))
    size, n, m = quality_rules.BUCKETS, sum(raw.values()), sum(trusted.values())
    p = lambda b: (raw[b] + 1) / (n + size)
    ratio = lambda b: np.log((trusted[b] + size * p(b)) / (m + size) / p(b))
    scores = [sum(map(ratio, grams(t))) / len(grams(t)) for t in texts]
    known = [(scores[k], y) for k, y in labels.items()]
    good = sorted(s for s, y in known if y)
    most = good[int(quality_rules.KEEP_LOST * (len(good) - 1))]
    quality = lambda cut: round(sum(s >= cut for s in good) / len(good) + sum(s < cut for s, y in known if not y) / (len(known) - len(good)), 9)
    best = min((c for c in {s for s, _ in known} if c <= most), key=lambda c: (-quality(c), c))
    cut = (best + max([s for s, _ in known if s < best], default=best)) / 2

    table = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    rows = {x.doc_id: x for x in quality_rules.quality_rules(make(texts), table).collect()}
    assert all(abs(rows[k].llr - s) < 1e-9 for k, s in enumerate(scores))
    assert all(rows[k].kept == (s >= cut and not rows[k].base_failed) for k, s in enumerate(scores) if abs(s - cut) > 1e-9)


def test_counts_cover_all_rows(spark, make):
    raw, trusted = quality_rules.corpus_counts(make(["a b c", "a b", None, "d"]), [1])
    assert (raw.sum(), trusted.sum()) == (5 + 3 + 1, 3)


# ---------------------------------------------------------------- codec


def test_codec_against_the_library():
    from tokenizers import Tokenizer

    with open(vocabulary_path()) as f:
        vocabulary = bpe_codec.Vocabulary(f.read())
    theirs = Tokenizer.from_file(vocabulary_path())
    words = [b" the", b"the", b" ther", b" other", b"er"]
    codec = bpe_codec.Codec(vocabulary, bpe_codec.compile_words(words, [vocabulary.merge(w) for w in words]))
    r = random.Random(4)
    alphabet = ["the", " other", "é", "日本", "\n", "  ", "\t", "'s", "'LL", "12", "½", "<|endoftext|>", "!!", "\u200b", "\x1c", "🙂", "a" * 40, "_", " \u00a0", "ſ"]
    texts = ["", "a" * 5000, " " * 999, "ab" * 400, *("".join(r.choice(alphabet) for _ in range(r.randint(1, 60))) for _ in range(400))]
    texts += [chr(c) + "a" + chr(c) + " " + chr(c) + "1" for c in [*range(1, 0x800), *(r.randrange(0x800, 0xD800) for _ in range(2000))]]
    ids, at = codec.encode(texts)
    back = codec.decode(ids, at)
    for k, text in enumerate(texts):
        wanted = theirs.encode(text, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == wanted, text
        assert back[k] == theirs.decode(wanted, skip_special_tokens=False) == text


def test_codec_query(spark, make, edges):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary_path())
    docs = make(edges)
    rows = {r.doc_id: r for r in bpe_codec.code_texts(docs, vocabulary_path(), keep_ids=True, keep_text=True).collect()}
    for k, text in enumerate(edges):
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert rows[k].ids == ids and rows[k].n_tokens == len(ids) and rows[k].decoded == (text or "")
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe_codec.code_texts(docs.limit(0), vocabulary_path()).count() == 0


def test_transducer_is_exact_and_shares_suffixes():
    r = random.Random(6)
    words = sorted({bytes(r.choice(b"abc") for _ in range(r.randint(1, 7))) for _ in range(400)})
    lexicon = bpe_codec.compile_words(words, [[i, i + 1] for i in range(len(words))])
    probes = [*words, b"", b"abcabcabcabc", *(w + b"z" for w in words[:50]), *(w[:-1] for w in words[:50])]
    offsets = np.cumsum([0] + [len(p) for p in probes])
    number = bpe_codec.look_up(lexicon, np.frombuffer(b"".join(probes), np.uint8), offsets)
    for p, k in zip(probes, number):
        assert (k >= 0) == (p in set(words))
        if k >= 0:
            assert lexicon["ids"][lexicon["at"][k] : lexicon["at"][k + 1]].tolist() == [words.index(p), words.index(p) + 1]
    # by Myhill and Nerode: as many states as different sets of endings
    endings = collections.defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            endings[w[:k]].add(w[k:])
    assert len(lexicon["final"]) == len({frozenset(v) for v in endings.values()})
    assert bpe_codec.look_up(bpe_codec.compile_words([], []), np.zeros(0, np.uint8), np.array([0, 0])).tolist() == [-1]


# ---------------------------------------------------------------- classifier


def test_quality_classifier(spark, make, edges):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    out = quality_classifier.score_quality(docs, model)
    held = out.filter(quality_classifier.held_out()).join(labels, "doc_id")
    assert out.count() == docs.count() and out.filter("score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert held.filter("predicted = quality").count() >= 0.93 * held.count()
    rows = quality_classifier.score_quality(make(edges), model).collect()
    assert len(rows) == len(edges) and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality_classifier.score_quality(make(edges), None).collect()} == {0.5}


def test_sample_is_counted_in_tasks(spark, make, monkeypatch):
    """Whole texts never reach the driver: what is collected for a text has a bound, whatever its length."""
    long = " ".join(f"w{i * 7919 % 90_001}" for i in range(400_000))
    texts = [None, "", "a few words", long]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([0, 1, 0, 1], pa.int32()), pa.array(texts, pa.string())], names=["i", "y", "t"])
    rows = pa.Table.from_batches(quality_classifier._counted([batch])).to_pylist()
    assert [r["length"] for r in rows] == [0, 0, 11, len(long)]
    assert all(len(r["buckets"]) <= 2 * 4096 and len(r["times"]) <= 4 * 4096 for r in rows) and len(long) > 2_000_000
    data = np.frombuffer(long.encode(), np.uint8)
    _, bucket, times = quality_classifier.term_counts(data, np.array([0, len(data)]))
    assert np.frombuffer(rows[3]["buckets"], np.int16).tolist() == bucket.tolist() and np.frombuffer(rows[3]["times"], np.int32).tolist() == times.tolist()
    seen = []
    monkeypatch.setattr(quality_classifier, "fit_vectors", lambda counted, labels: seen.extend(counted) or {"labels": np.array(labels)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality_classifier.fit(make([long] * 20), labels)
    assert len(seen) > 5 and all(sum(map(len, r[1:])) <= 6 * 4096 for r in seen)


def test_projection_against_plain_counts():
    r = random.Random(13)
    texts = ["", "one", "it it it it", *(" ".join(r.choice(["alpha", "Beta", "7", "x,", "é"]) for _ in range(r.randint(1, 60))) + r.choice(["", "\n$$ %"]) for _ in range(20))]
    counts = lambda t: dict(zip(*[x.tolist() for x in quality_classifier.term_counts(*common.utf8_view(pa.array([t]))[:2])[1:]]))
    own_bucket = lambda w: next(b for b in counts(w) if 0 < b < quality_classifier.WORD_BUCKETS)
    rng = np.random.default_rng(2)
    weights, basis = rng.random(quality_classifier._BUCKETS).astype(np.float32), rng.normal(size=(quality_classifier._BUCKETS, 5)).astype(np.float32)
    got = quality_classifier.project(pa.array(texts), weights, basis)
    for t, vector in zip(texts, got):
        words, raw, found = re.findall("[^\x20\x09-\x0D]+", t), t.encode(), collections.Counter()
        for a, b in zip([None, *words], words):
            found[own_bucket(b)] += 1
            found[0] += a == b
        for k in range(len(raw) - 3):
            code = 0
            for byte in raw[k : k + 4]:
                code = code * 8 + int(quality_classifier._SHAPE[byte])
            found[quality_classifier.WORD_BUCKETS + code % quality_classifier.SHAPE_BUCKETS] += 1
        dense = np.zeros(quality_classifier._BUCKETS)
        for b, n in found.items():
            dense[b] = np.log1p(n / max(len(raw), 200) * 1000)
        wanted = (dense * weights) @ basis
        assert np.allclose(vector, wanted / max(np.linalg.norm(wanted), 1e-9), atol=1e-4)


def test_equal_texts_have_equal_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = common.unpacked(quality_classifier.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet")))
    texts = [r.text for r in docs.select("text").limit(300).collect()]
    score = lambda t: quality_classifier.vote(quality_classifier.project(pa.array(t), model["weights"], model["basis"]), model)
    together = score(texts)
    alone = np.concatenate([score([t]) for t in texts[:100]])
    shifted = score(["some other text"] * 77 + texts)[77:]
    assert (together[:100] == alone).all() and (together == shifted).all()


def test_equally_near_neighbours_go_by_place():
    known = np.array([[1.0, 0.0]] * 40 + [[0.0, 1.0]] * 40, np.float32)
    labels = np.array([1.0] * 15 + [0.0] * 25 + [1.0] * 40, np.float32)
    model = {"vectors": known, "labels": labels}
    assert quality_classifier.vote(np.array([[1.0, 0.0]], np.float32), model)[0] == 1.0


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    known, asked, labels = unit(rng.normal(size=(90, 8))), unit(rng.normal(size=(700, 8))), rng.integers(0, 2, 90).astype(np.float32)
    found = quality_classifier.vote(asked, {"vectors": known, "labels": labels})
    share = labels.mean()
    for v, got in zip(asked[::50], found[::50]):
        near = sorted(range(90), key=lambda i: -float(known[i] @ v))[: quality_classifier.NEIGHBOURS]
        weight = {i: np.exp(quality_classifier.STEEP * (float(known[i] @ v) - 1)) * 0.5 / (share if labels[i] else 1 - share) for i in near}
        assert abs(sum(w * labels[i] for i, w in weight.items()) / sum(weight.values()) - got) < 1e-4


# ---------------------------------------------------------------- html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site header, with commas, and more, text that is long enough to score.</p></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="notice">We use cookies, please agree, or go away, this is a long notice.</div>
<article><h1>The &amp; title</h1><p><b>First paragraph,
 with  some text, that goes on &lt;and on&gt;, so that it scores.<br>Second line.<p>Another one, which was never closed, but is long enough to count.</p>
<div class="ad">Buy now, cheap, cheap, and cheaper still, right here and now.</div><ul><li>An item, in the list, of the article, long enough.</li></ul>
<form><p>Your mail address, please, to get our letter, every week.</p></form><!-- gone --></article>
<section id="comments"><p>I disagree, strongly, with everything, that was said, above here.</p></section>
<aside><p>Related, things, to read, when you have time for it, as you may.</p></aside><footer>&copy; Somebody</footer></body></html>"""


def test_html_main_text():
    assert html_extraction.main_text(PAGE).split("\n") == [
        "The & title", "First paragraph, with some text, that goes on <and on>, so that it scores. Second line.",
        "Another one, which was never closed, but is long enough to count.", "An item, in the list, of the article, long enough.",
    ]


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', "div id=with-header", "div class=widget", "form action=x", "aside", 'div class="post comments-open"'])
def test_html_in_a_wrapper(wrapper):
    """A wrapper with a boilerplate mark around the article, alone or nested, hides nothing; marks inside still count."""
    close = wrapper.split()[0]
    body = "".join(f"<p>Sentence {i}, with commas, and words enough, to be taken for prose by any reader.</p>" for i in range(5))
    inside = '<div class=ad><p>Buy now, cheap, cheap, and cheaper still, right here and now.</p></div>'
    around = "<div class=sidebar><p>Related, things, to read, when you have time for it, as you may.</p></div>"
    pages = [f"<body><{wrapper}><article>{body}{inside}</article></{close}>{around}</body>", f"<form><{wrapper}><main>{body}{inside}</main></{close}></form>{around}"]
    if "comments" not in wrapper:
        pages += [f"<body><{wrapper}>{body}{inside}</{close}>{around}</body>"]
    for page in pages:
        text = html_extraction.main_text(page)
        assert text.count("Sentence") == 5 and "Buy" not in text and "Related" not in text
    thread = "".join(f"<p>I disagree, strongly, with everything, that was said above, number {i}.</p>" for i in range(30))
    text = html_extraction.main_text(f"<body><div>{body}</div><div class=comments>{thread}</div></body>")
    assert text.count("Sentence") == 5 and "disagree" not in text


def test_html_without_an_article_element():
    body = "".join(f"<p>Sentence {i}, with commas, and words enough, to be taken for prose by any reader.</p>" for i in range(5))
    page = f"<body><div class=menu><a href=x>one</a> <a href=y>two</a></div><div><div id=main>{body}</div><div><a href=z>{'link ' * 40}</a></div></div></body>"
    assert html_extraction.main_text(page).count("\n") == 4 and "link" not in html_extraction.main_text(page)


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<p", '<a href="x', "</p></p>", "<b>" * 3000 + "x", "<script>never closed", "<!-- never closed", "&#xZZ; &nosuch; &#0;", "<p>" * 500])
def test_broken_html(page):
    assert isinstance(html_extraction.main_text(page), str)


def naive_text(tree):
    """The article of a tree of (tag, children) by the scoring rules, computed anew for each element."""
    block = lambda t: t in ("div", "p", "section", "body")
    strings = lambda node: [k for k in node[1] if isinstance(k, str)]

    def size(node, linked=False, inside=False):
        inside = inside or node[0] == "a"
        own = sum(len(s.strip()) for s in strings(node)) if inside or not linked else 0
        return own + sum(size(k, linked, inside) for k in node[1] if not isinstance(k, str))

    def commas(node):
        return sum(s.count(",") for s in strings(node)) + sum(commas(k) for k in node[1] if not isinstance(k, str) and not block(k[0]))

    def gained(node):
        inline = all(isinstance(k, str) or not block(k[0]) for k in node[1])
        own = sum(len(s.strip()) for s in strings(node))
        length = size(node) if inline else own
        if not (block(node[0]) and node[0] != "body" and (inline or own > 25) and length >= 25):
            return 0.0
        return (1 + commas(node) + min(length / 100, 3)) * (1 - size(node, True) / max(size(node), 1))

    def points(node, depth=0):
        own = gained(node) * 0.5 ** (depth - 1) if depth else (gained(node) if node[0] in ("div", "section") else 0.0)
        return (own if depth <= 4 else 0.0) + sum(points(k, depth + 1) for k in node[1] if not isinstance(k, str))

    everything, order = [], [0]

    def walk(node, up, depth):
        everything.append((node, up, depth, order[0]))
        order[0] += 1
        for k in node[1]:
            if not isinstance(k, str):
                walk(k, node, depth + 1)

    walk(tree, None, 0)
    score = lambda n: points(n) * (1 - size(n, True) / max(size(n), 1))
    open_ = [(score(n), depth, -at, n, up) for n, up, depth, at in everything if n[0] != "p" and points(n) > 0]
    if not open_:
        return None
    top, _, _, best, up = max(open_, key=lambda x: x[:3])
    out = []

    def lines(node):
        run = []

        def flush():
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append(text)

        def inner(n):
            if block(n[0]):
                flush()
            for k in n[1]:
                run.append(k) if isinstance(k, str) else inner(k)
            if block(n[0]):
                flush()

        inner(node)
        flush()

    for kid in up[1] if up is not None and best[0] != "body" else [best]:
        if isinstance(kid, str):
            continue
        density = size(kid, True) / max(size(kid), 1)
        prose = kid[0] == "p" and (size(kid) > 80 and density < 0.25 or size(kid) > 40 and density == 0 and points(kid) == 0)
        if kid is best or score(kid) >= max(2.0, 0.2 * top) or prose:
            lines(kid)
    return "\n".join(out)


def test_scoring_against_a_naive_scorer():
    r = random.Random(21)
    words = lambda n: " ".join(r.choice(["stone", "river,", "of", "a", "lantern", "seven", "it,"]) for _ in range(n))

    def grow(depth):
        kids = []
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if kind < 0.5 or depth > 5:
                kids.append(("p", [words(r.choice([2, 8, 30, 60]))] + ([("a", [words(r.choice([1, 5, 20]))])] if r.random() < 0.4 else [])))
            elif kind < 0.6:
                kids.append(("a", [words(6)]))
            else:
                kids.append((r.choice(["div", "section"]), grow(depth + 1)))
        return kids

    show = lambda n: n if isinstance(n, str) else f"<{n[0]}>{''.join(map(show, n[1]))}</{n[0]}>"
    compared = 0
    for _ in range(150):
        tree = ("body", grow(0))
        wanted = naive_text(tree)
        if wanted is not None:
            compared += 1
            assert html_extraction.main_text(show(tree)) == wanted
    assert compared > 100


def test_broken_pages_take_time_in_proportion():
    import time

    for page in ("<div>" * 20_000 + "</b>" * 20_000, "<svg>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<b><article>" + "</b>" * 40_000, '<a href="x>' * 20_001):
        start = time.process_time()
        html_extraction.main_text(page)
        assert time.process_time() - start < 5


def test_html_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = html_extraction.extract_text(pages.withColumn("text", F.lit("clash")))
    assert out.count() == pages.count() and out.filter("n_chars <> length(text) or n_chars = 0").count() == 0
    joined = out.join(pages, "page_id").select("text", "html").collect()
    assert all("track(" not in r.text and "&amp;" not in r.text for r in joined)
    assert html_extraction.extract_text(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- urls


def judge_by_hand(url):
    import urllib.parse  # noqa: F401  only the plain rules below are used

    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(text), v, text) for v, text in url_filters.RULES if (h := text.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith(text[len(h) :])]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    bad = set(re.split("[.-]", host)) & set(url_filters.BLOCKED_WORDS)
    return host, path, None, "block" if bad else "allow"


def test_urls_against_brute_force(spark):
    urls = [
        None, "", "nothing", "http://", "http://NET", "http://a.NET/", "http://net/x", "http://xnet/", "https://www.example.net/en/1", "https://example.net/en", "https://example.net/EN/", "http://example.com/de/?q=http://x/",
        "http://notexample.com/de/", "http://a.example.com/de/x#y", "http://example.org/fr/", "http://org/fr/x", "http://org?/fr/", "http://www.casino-win.example.org/en", "http://casinos.example.org/", "a://b://c/d", "http://İ.net/", "http://x.net?y",
        "http://x.net#/", "http://user@x.net:80/", "http://x.y.z." + "a" * 3000 + ".net/" + "p" * 5000,
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df).collect()}
    assert rows == {i: judge_by_hand(u) for i, u in enumerate(urls)}
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_listed_sites_against_brute_force(spark):
    r = random.Random(7)
    name = lambda: r.choice(["a", "b", "c", "cd", "poker"]) + r.choice(["", "1", "-x"])
    sites = {f"{name()}.{name()}.test{r.choice(['', '/', '/p/', '/p/q'])}": r.choice(["allow", "block"]) for _ in range(60)}
    many = [("block", f"h{k}.example.invalid") for k in range(200_000)]
    listed = spark.createDataFrame([(v, s) for s, v in sites.items()] + many, "verdict string, site string")
    urls = [f"http://{'.'.join(name() for _ in range(r.randint(1, 3)))}.test{r.choice(['', '/', '/p', '/p/', '/p/q/z', '?x'])}" for _ in range(400)]
    urls += ["http://h77.example.invalid", "http://h77.example.invalid/x", "http://h200000.example.invalid/", "http://a.net/"]

    def judge(url):
        host, path, rule, verdict = judge_by_hand(url)
        if rule:
            return verdict
        fits = []
        for s, v in [*sites.items(), *((s, v) for v, s in many if s.split(".")[0] in url)]:
            h, slash, p = s.partition("/")
            if (host == h or host.endswith("." + h)) and (not p or path.startswith("/" + p)):
                fits.append((len(h) + 1 + len(p), v == "allow", v))
        return max(fits)[2] if fits else verdict

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = {x.page_id: x.verdict for x in url_filters.judge_urls(df, listed=listed).collect()}
    assert rows == {i: judge(u) for i, u in enumerate(urls)}


def test_digest_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(url_filters.xxhash, "xxh64_intdigest", lambda k: 7)
    index = url_filters.Index(url_filters.build_index())
    assert index.probe(["rnet/", "rexample.net/en/", "wcasino", "rnot/", "w"]).tolist() == [2, 1, 3, 0, 0]


def test_url_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    found = sorted(tuple(r) for r in url_filters.query(spark, SF).collect())
    assert found == sorted(c.sql(url_filters.ORACLE_SQL).project("page_id, host, path, rule, verdict").fetchall())


def naive_short_page(tree):
    """All lines of a tree of (tag, children) but those of blocks that are links for the most part."""
    block = ("p", "h2", "ul", "li", "div", "body")
    size = lambda n, linked: sum(len(k.strip()) * (linked in (False, n[0] == "a")) if isinstance(k, str) else size(k, linked and n[0] != "a") for k in n[1])
    out, run = [], []

    def flush():
        line = " ".join("".join(run).split())
        run.clear()
        if line:
            out.append(line)

    def walk(n):
        if n[0] in block:
            flush()
        for k in n[1]:
            if isinstance(k, str):
                run.append(k)
            elif not (k[0] in block and 0 < size(k, True) and 2 * size(k, True) >= size(k, False)):
                walk(k)
        if n[0] in block:
            flush()

    walk(tree)
    flush()
    return "\n".join(out)


def test_pages_without_long_paragraphs():
    assert html_extraction.main_text("<h2>Intro</h2><p>Hi.</p><p>Short one.</p>") == "Intro\nHi.\nShort one."
    assert html_extraction.main_text("<body>bare<ul><li>one<li>two</ul><div class=ad>buy</div><nav>home</nav><ul><li><a href=x>menu</a></ul>end") == "bare\none\ntwo\nend"
    r = random.Random(13)
    word = lambda: r.choice(["tea", "ox", "so it is", "yes,"])
    show = lambda n: n if isinstance(n, str) else f"<{n[0]}>{''.join(map(show, n[1]))}</{n[0]}>"
    for _ in range(200):
        kids = []
        for _ in range(r.randint(1, 6)):
            kind = r.random()
            inline = lambda: ("a", [word()]) if r.random() < 0.4 else word()
            if kind < 0.2:
                kids.append(("h2", [word()]))
            elif kind < 0.5:
                kids.append(("p", [inline()]))
            elif kind < 0.7:
                kids.append(("ul", [("li", [inline()]) for _ in range(r.randint(1, 3))]))
            elif kind < 0.85:
                kids.append(("div", [("p", [inline()]), word()]))
            else:
                kids.append(f" {word()} ")
        tree = ("body", kids)
        assert html_extraction.main_text(show(tree)) == naive_short_page(tree)


def test_short_blocks_beside_the_best():
    prose = "<div>" + "".join(f"<p>Sentence {i}, with commas, and words enough, to be taken for prose by any reader.</p>" for i in range(4)) + "</div>"
    page = f"<div><h2>Head</h2>bare words{prose}<ul><li>item</li></ul><ul><li><a href=x>elsewhere</a></li></ul><blockquote>said</blockquote></div>"
    lines = html_extraction.main_text(f"<body>{page}<div class=footer>foot</div></body>").split("\n")
    assert lines[:2] == ["Head", "bare words"] and lines[-2:] == ["item", "said"] and len(lines) == 8
    # a marked article has its own bounds
    assert html_extraction.main_text(f"<body><h2>Site</h2>slogan<article>{prose}</article></body>").count("\n") == 3


def test_blocked_sites_by_hand(spark):
    urls = [f"http://Deal.example.org/{w}" for w in ("casino/1", "x?q=poker", "plain")] + ["http://ok.example.org/casino"] * 2 + [f"http://fine.example.org/{i}" for i in range(5)] + ["http://fine.example.org/casino", None, "casino", "http:///casino"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert [tuple(x) for x in url_filters.blocked_sites(df).collect()] == [("block", "deal.example.org")]
    verdicts = {x.page_id: x.verdict for x in url_filters.judge_urls(df, listed=url_filters.blocked_sites(df)).collect()}
    assert [k for k, v in verdicts.items() if v == "block"] == [0, 1, 2]


def test_long_lists_reach_the_driver_as_bytes(spark, monkeypatch):
    import tracemalloc

    listed = spark.range(300_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("site"), F.col("id").cast("string"), F.lit(".example.invalid")).alias("site"))
    tracemalloc.start()
    blob = url_filters.build_listed_index(listed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 12_000_000 < len(blob) < 14_500_000 and peak < 5 * len(blob)
    index = url_filters.Index(blob)
    assert (np.diff(index.digest.astype(object)) >= 0).all()
    assert index.probe(["ssite299999.example.invalid/", "ssite300000.example.invalid/", "rnet/", "wcasino"]).tolist() == [5, 0, 2, 3]
    monkeypatch.setattr(url_filters, "MOST_BYTES", 1 << 20)
    with pytest.raises(ValueError, match="listed sites take"):
        url_filters.build_listed_index(listed)


def test_ids_of_any_type(spark, make):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    for module, score in ((quality_rules, lambda d, y: quality_rules.quality_rules(d, y)), (quality_classifier, lambda d, y: quality_classifier.score_quality(d, quality_classifier.fit(d, y)))):
        rows = score(named(docs), named(labels))
        column = "kept" if module is quality_rules else "predicted"
        good = rows.join(named(labels).select("doc_id", "quality"), "doc_id").select(F.avg((F.col(column).cast("int") == F.col("quality")).cast("int"))).first()[0]
        assert rows.count() == docs.count() and good > 0.9


def test_thresholds_come_from_all_scores(spark):
    """The cut over ranges equals the one over the whole array, and no number of labelled rows bounds it."""
    r = np.random.default_rng(5)
    for n, bad in ((3, 0), (12_000, 7_000)):
        scores, good = np.round(r.normal(size=n), 3), np.arange(n) >= bad
        scores[~good] -= 1
        most = np.quantile(scores[good], quality_rules.KEEP_LOST, method="lower")
        cuts = np.unique(scores)
        cuts = cuts[cuts <= most]
        best = cuts[np.argmax([np.round((scores[good] >= c).mean() + (scores[~good] < c).mean(), 9) for c in cuts])] if bad else most
        lower = scores[scores < best]
        wanted = (best + lower.max()) / 2 if bad and len(lower) else best
        scored = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good)], "s double, good boolean")
        assert quality_rules.pick_threshold(scored) == wanted
    assert not hasattr(quality_rules, "SAMPLE")


def test_labels_are_joined_to_packed_grams(spark, make, edges):
    """Packed n-grams give the scores of their texts to the last bit; texts are not shuffled, and the plan does not change with size."""
    texts, ratios = pa.array(edges), quality_rules.log_ratios(np.random.default_rng(3).integers(1, 99, (2, quality_rules.BUCKETS)))
    data, offsets, _ = common.utf8_view(texts)
    row, bucket, _ = quality_rules._features(data, offsets)
    column = quality_rules.pack_grams(row, bucket, len(edges))
    assert sorted(zip(*quality_rules._grams(*common.utf8_view(column)[:2]))) == sorted(zip(row, bucket))
    assert quality_rules.score_grams(column, ratios).tolist() == quality_rules._judge(texts, {"ratios": ratios, "cut": [0.0]})[3].tolist()
    assert column.nbytes < 0.5 * len(data)

    labels = spark.createDataFrame([(k, k % 2) for k in range(0, len(edges), 2)] + [(2, 1), (None, 1)], "doc_id long, quality int")
    known = quality_rules.labelled(make(edges, ids=[None, *range(1, len(edges))]), labels)
    assert sorted((r.i, r.good) for r in known.collect()) == [(k, k == 2) for k in range(2, len(edges), 2)]
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
