"""Conversation repair, secret scans and spelling variants, against brute force."""

import collections
import hashlib
import heapq
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from idweave.llm import conversation_repair, secret_scan, spelling_variants

SF = "/root/testdata/sf0.01"

# ---------------------------------------------------------------- conversations

_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def cheapest(rows):
    """(cost, audit, [(edit, row, initial)]) by a search over whole edit strings; rows are (initial, must go, truncated)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        for r in "ua":
            if (q, r) in _STEP:
                heapq.heappush(heap, (cost + 3, audit + "I", i, _STEP[q, r], (*out, ("I", i, r))))
        if i < len(rows):
            initial, must, truncated = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, q, out))
            if not must:
                if (q, initial) in _STEP:
                    heapq.heappush(heap, (cost + 3 * truncated, audit + "K", i + 1, _STEP[q, initial], (*out, ("K", i, initial))))
                for r in "ua":
                    if (q, r) in _STEP:
                        heapq.heappush(heap, (cost + 3 + 3 * truncated, audit + "R", i + 1, _STEP[q, r], (*out, ("R", i, r))))


def test_block_tables_against_search():
    r = random.Random(1)
    for _ in range(3000):
        rows = [(r.choice("suax"), r.random() < 0.2, r.random() < 0.25) for _ in range(r.randint(0, 14))]
        symbols = [8 if must else "sua".find(i) % 4 + 4 * t for i, must, t in rows]
        assert conversation_repair.edits(symbols) == cheapest(rows)[:2]
    one, _, block, _, _, vectors = conversation_repair.tables()
    assert len(vectors) < 64 and block.shape == (len(vectors), 10**conversation_repair.BLOCK) and one.max() < len(vectors)


def repaired_by_hand(rows):
    """Contract columns of one conversation: rows (turn, role, text) before damage, in order."""
    after = []
    for conv, turn, role, text in rows:
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        after += [(turn, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1)
    seen, faults = set(), []
    for _, role, text in after:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = [t for t, _, _ in after if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    cost, audit, out = cheapest([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(after, faults)])
    full = {"u": "user", "a": "assistant"}
    lines = [f"{full[r]}:" if e == "I" else f"{after[i][1] if e == 'K' else full[r]}:{after[i][2]}" for e, i, r in out]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_conversation_query_against_search(spark):
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.query(spark, SF).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    rows = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows[r.conv_id].append((r.conv_id, r.turn, r.role, r.text))
    assert got == {conv: repaired_by_hand(own) for conv, own in rows.items()}


def test_conversation_edges(spark, tmp_path):
    long = "word " * 40_000 + "end."
    rows = [(None, 0, "user", "Hi."), (None, None, None, None), (1, None, "user", "First."), (1, 3, "assistant", long), (1, 3, "assistant", long), (2, 5, "", "x!"), (2, 9, "system", "late?")]
    rows += [(3, t, r.choice(["user", "assistant", "tool", None]), r.choice(["Yes.", "no", "", " \n", None, "naïve…", "日本!"])) for r in [random.Random(4)] for t in range(300)]
    rows += [(4, t, "user", None) for t in range(3)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, plan string, audit string").repartition(3)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.query(spark, str(tmp_path)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    own = collections.defaultdict(list)
    for r in rows:
        own[r[0]].append(r)
    assert got == {c: repaired_by_hand(sorted(v, key=lambda r: (r[1] is not None, r[1] or 0))) for c, v in own.items()}
    turns = conversation_repair.repair(frame).orderBy("conv", "place").collect()
    for conv in own:
        roles = "".join(r.role[0] for r in turns if r.conv == conv)
        assert re.fullmatch("(s?(ua)+)?", roles)
    assert conversation_repair.repair_report(frame.limit(0)).count() == 0 and conversation_repair.repair(frame.limit(0)).count() == 0
    named = frame.withColumn("conv_id", F.concat(F.lit("c"), "conv_id"))
    assert {r.conv for r in conversation_repair.plan_repairs(named).collect()} == {None, "c1", "c2", "c3", "c4"}


def test_conversations_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_conversation_query_against_search(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---------------------------------------------------------------- secrets


def base_by_hand(text):
    key = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


_HEX40 = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
TRICKY = [
    f'é token = "{_HEX40}" end', "token: token: abcdefgh", "PassWord'=  'secret=abcdefgh", "toKen=abcdefgh", "ſecret=abcdefgh", "api_key=12345 APIKEY:123456 apikey=abc.def-",
    "AKIAAKIA" + "Z" * 16, "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "x", "0" * 23, "g" + "0" * 24, "A" + _HEX40.upper(), _HEX40 + "g" + _HEX40, "token = \n abcdefgh", 'secret"="abcdef"', "passwd==abcdef",
]


def test_base_spans_by_hand(spark, make, edges):
    texts = [*edges, *TRICKY]
    r = random.Random(8)
    texts += ["".join(r.choice(["token", "secret", "=", ": ", '"', "AKIA", "api_key", _HEX40[: r.randint(1, 40)], "A1B2C3D4E5", " ", "é", "."]) for _ in range(r.randint(1, 30))) for _ in range(300)]
    found = {r.doc_id: r for r in secret_scan.find_secrets(make(texts)).select("doc_id", "base", "spans", secret_scan.spans_text(F.col("base")).alias("text")).collect()}
    for i, text in enumerate(texts):
        wanted = base_by_hand(text or "")
        assert [tuple(s) for s in found[i].base] == wanted
        assert found[i].text == ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in wanted)
        assert [tuple(s) for s in found[i].spans if s.kind < 3] == wanted and sorted(found[i].spans) == found[i].spans
    assert secret_scan.find_secrets(make(texts).limit(0)).count() == 0


def test_secret_query(spark):
    rows = {r.doc_id: r for r in secret_scan.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        wanted = base_by_hand(d.text or "")
        r = rows[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(k == x for _, k, _ in wanted) for x in range(3)), digest(wanted))


def test_random_tokens_are_found_and_text_is_left_alone(spark, make):
    r = random.Random(5)
    words = [w for d in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect() for w in re.findall("[A-Za-z]+", d.text or "")]
    draw = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    alnum = string.ascii_letters + string.digits
    secrets = [draw(alnum, 40) for _ in range(30)] + [draw(alnum + "+/", 64) for _ in range(10)] + [draw(alnum + "-_", 48) for _ in range(10)] + [draw(string.digits + string.ascii_lowercase, 44) for _ in range(10)]
    plain = ["A" * 40, "0123456789abcdefghij" * 3, "https/example/org/some/long/path/name", "abcABC123" * 6, "getUserProfileByIdentifierNameAndDate", "user_name_with_many_parts_in_it_2024", "6f1d2c3b-aaaa-4444-8888-123412341234"]
    texts = []
    for k in range(400):
        own = r.sample(words, 40)
        special = secrets[k] if k < len(secrets) else plain[k % len(plain)] if k % 2 else "".join(r.sample(words, 6))
        texts.append(" ".join([*own[:20], special, *own[20:]]))
    found = {x.doc_id: [(s.start, s.end) for s in x.spans if s.kind == 3] for x in secret_scan.find_secrets(make(texts)).collect()}
    hits = [any(texts[k][a:b] in secrets[k] or secrets[k] in texts[k][a:b] for a, b in found[k]) for k in range(len(secrets))]
    false = sum(len(found[k]) for k in range(len(secrets), len(texts)))
    assert np.mean(hits) >= 0.9 and false <= 2


def test_battery_by_hand():
    r = np.random.default_rng(2)
    sums = secret_scan.battery(r.integers(0, 16, (4000, 60)), 16)
    # three p-values that are nearly uniform: mean 6 and the chi-squared quantiles
    assert abs(sums.mean() - 6) < 0.5 and 0.005 < np.mean([secret_scan.chance(s) < 0.01 for s in sums]) < 0.03
    for row in ([0] * 40, list(range(16)) * 3, [0, 15] * 30):
        assert secret_scan.chance(float(secret_scan.battery(np.array([row]), 16)[0])) < 1e-3
    assert [secret_scan.encoding(t) for t in ("0123", "12ab", "12AB", "word", "WORD", "WORD22", "word9", "aB", "aB1", "a+", "a_", "a.")] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11, None]
    # the step-up by hand: 3 of 5 tokens pass at 5 %
    assert secret_scan.discovery_bin({100: 2, 48: 1, 4: 2}, 0.05) == 48 and secret_scan.discovery_bin({4: 5}) == secret_scan.BINS and secret_scan.discovery_bin({}) == secret_scan.BINS


def test_pair_counts_do_not_cross_rows(spark, make):
    texts = ["ab", "cd ef", None, "x" * 20 + " gh", "é1"]
    got = {r.pair: r.n for r in secret_scan.pair_counts(make(texts)).collect()}
    wanted = collections.Counter()
    for text in texts:
        own = [c for c in re.sub("x{20}", "", text or "") if c in secret_scan._ALL]
        wanted.update(secret_scan._ALL.index(a) * len(secret_scan._ALL) + secret_scan._ALL.index(b) for a, b in zip(own, own[1:]))
    assert got == dict(wanted)


# ---------------------------------------------------------------- spelling variants


def words_by_hand(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in string.ascii_uppercase else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            n[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def variants_by_hand(n):
    def one_apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and one_apart(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def as_rows(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = variants_by_hand(words_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert len(wanted) > 1000 and as_rows(spelling_variants.query(spark, str(tmp_path))) == wanted


@pytest.mark.parametrize("box,leaf,sample", [(16384, 12, 131072), (40, 2, 150)])
def test_variants_against_all_pairs(spark, make, edges, tmp_path, monkeypatch, box, leaf, sample):
    monkeypatch.setattr(spelling_variants, "BOX", box)
    monkeypatch.setattr(spelling_variants, "LEAF", leaf)
    monkeypatch.setattr(spelling_variants, "SAMPLE", sample)
    r = random.Random(3)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(7, 10))) for _ in range(60)]
    texts = [*edges, "Wörter× " * 30, "wörter÷ " * 3, "z" * 700 + " " + "z" * 701, "z" * 700 + " " + "z" * 701]
    for _ in range(250):
        words = []
        for _ in range(30):
            w = r.choice(base)
            at = r.randrange(len(w))
            words.append(r.choice([w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + r.choice("abz") + w[at:], w[:at] + r.choice("abz") + w[at + 1 :], w[::-1]]))
        texts.append(r.choice([" ", "-", "日"]).join(words))
    ids = [None if k % 50 == 7 else k // 2 for k in range(len(texts))]
    make(texts, ids=ids).write.parquet(str(tmp_path / "documents.parquet"))
    wanted = variants_by_hand(words_by_hand(zip(ids, texts)))
    got = as_rows(spelling_variants.query(spark, str(tmp_path)))
    assert len(wanted) > 500 and any(v[0] for v in wanted.values()) and got == wanted


def test_variant_chains_and_ties(spark):
    counts = {"aaaaaaa": 5000, "aaaaaab": 400, "aaaaabb": 30, "aaaabbb": 2, "zzzzzzz": 3, "zzzzzzy": 30, "zzzzzzx": 30, "qqqqqqq": 2}
    frame = spark.createDataFrame([(w.encode(), n) for w, n in counts.items()], "raw binary, n long")
    assert as_rows(spelling_variants.variant_groups(frame)) == variants_by_hand(counts)
    assert as_rows(spelling_variants.variant_groups(frame))["aaaabbb"][1] == "aaaaaaa" and as_rows(spelling_variants.variant_groups(frame))["zzzzzzz"][0] == "zzzzzzx"
    assert spelling_variants.variant_groups(frame.limit(0)).count() == 0


def test_tree_prunes_no_neighbour():
    r = np.random.default_rng(6)
    points = r.integers(0, 4, (3000, spelling_variants._AXES)).astype(np.int32)
    points[:500] = points[0]  # equal vectors are no reason to cut on
    tree, place = spelling_variants.Tree.build(points, 10)
    assert (tree.leaf_of(points) == place).all()
    queries = points[::7] + r.integers(-1, 2, (len(points[::7]), spelling_variants._AXES)) * (r.random((len(points[::7]), spelling_variants._AXES)) < 0.05)
    found = collections.defaultdict(set)
    for leaf, own in tree.reach(queries, 1, 1):
        for q in own:
            found[q].update(np.flatnonzero(place == leaf))
    for q in range(len(queries)):
        change = points - queries[q]
        near = np.flatnonzero((np.maximum(change, 0).sum(1) <= 1) & (np.maximum(-change, 0).sum(1) <= 1))
        assert set(near) <= found[q]
