"""URL filters over a sorted digest array.

Keys (host + path of a rule or of a listed site, or a word) are hashed with 64-bit xxhash and
sorted into one array that every worker memory-maps.  The candidate keys of a batch of urls are
probed by a vectorised binary search; a hit counts only if the stored full string is the same, so
hash collisions cannot change a verdict.  Rules come first; a url that none fits is judged by the
longest listed site that fits it, and without one by the words of its host.

Listed sites come from a table, such as a public block list or ``blocked_sites``, which lists the
hosts whose urls mostly hold blocked words.  Spark hashes and sorts them with the other keys and
packs each sorted range into bytes; what reaches the driver is those bytes, whose number is
known and bounded before.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and
is allowed.  Rows are judged one by one, so repeated rows repeat and an empty table gives none.
Ties cannot occur: of the rules that fit, the longest host + path wins, and two rules of the
same length that fit one url are the same string.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from .common import mapped, packed, table, unpacked

#: (verdict, host + path); fixed values given with the task.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words that block a url that no rule fits, if one (or its plural) is a part of its host between dots and hyphens.
BLOCKED_TOPICS = {
    "gambling": "bet betting bookmaker casino gambling jackpot lottery poker roulette slot sportsbook wager",
    "adult": "adult camgirl erotic escort fetish hentai milf nude porn porno sex xxx",
    "pharmacy": "cialis levitra pill steroid tramadol viagra xanax",
    "fraud": "malware phishing ransomware scam spam spyware trojan",
    "piracy": "crack keygen nulled warez",
    "advertising": "ad adserver adtrack banner clickbait popunder popup",
}


def word_keys(topics=None):
    """Each listed word and its plural, in order."""
    words = {w for line in (BLOCKED_TOPICS if topics is None else topics).values() for w in line.split()}
    return tuple(sorted(words | {w + "s" for w in words}))


BLOCKED_WORDS = word_keys()
#: Bytes that the packed array takes, at most; a longer list is refused.
MOST_BYTES = 256 << 20
#: A host is listed if it has so many urls, and more than half of them hold a blocked word between other characters.
LEAST_URLS = 3

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SCHEMA = "host string, path string, rule string, verdict string"


def split_url(url):
    """(host, path) of a url; both empty where it is null or has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def build_index(rules=RULES, words=BLOCKED_WORDS):
    """The sorted digest array with its full strings, as one byte string.

    Kinds: 1 allow rule, 2 block rule, 3 blocked word, 4 allowed site, 5 blocked site.  Keys are
    ``r`` (rule) or ``s`` (site) + host + path, or ``w`` + word.  A site on both lists is allowed.
    """
    entries = {"r" + text: 1 if verdict == "allow" else 2 for verdict, text in rules} | {"w" + w: 3 for w in words}
    entries = sorted(((key.encode(), kind) for key, kind in entries.items()), key=lambda e: (xxhash.xxh64_intdigest(e[0]), e[0]))
    raw = [e[0] for e in entries]
    return packed({
        "digest": np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64),
        "kind": np.array([e[1] for e in entries], np.int8),
        "at": np.cumsum([0] + [len(r) for r in raw], dtype=np.int64),
        "text": np.frombuffer(b"".join(raw), np.uint8),
        "rule_lengths": np.array(sorted({len(text) - text.index("/") for _, text in rules}), np.int64),
        "site_lengths": np.zeros(0, np.int64),
    })


class Index:
    """Probes of a mapped digest array."""

    def __init__(self, buffer):
        parts = unpacked(buffer)
        self.digest, self.kind, self.at = parts["digest"], parts["kind"], parts["at"]
        self.text = parts["text"].tobytes()
        self.lengths = {kind: parts[name].tolist() for kind, name in (("r", "rule_lengths"), ("s", "site_lengths"))}

    def probe(self, keys):
        """Kind of each key's entry, 0 where there is none."""
        found = np.zeros(len(keys), np.int8)
        if not keys or not len(self.digest):
            return found
        wanted = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        low = np.searchsorted(self.digest, wanted, "left")
        hit = np.flatnonzero(self.digest[np.minimum(low, len(self.digest) - 1)] == wanted)
        for i in hit.tolist():
            k, key = int(low[i]), keys[i].encode()
            while k < len(self.digest) and self.digest[k] == wanted[i]:
                if self.text[self.at[k] : self.at[k + 1]] == key:
                    found[i] = self.kind[k]
                    break
                k += 1
        return found

    def judge(self, urls):
        """Lists of host, path, rule and verdict."""
        hosts, paths, keys, owner = [], [], [], []
        for i, url in enumerate(urls):
            host, path = split_url(url)
            hosts.append(host)
            paths.append(path)
            if not host:
                continue
            labels = host.split(".")
            for kind, lengths in self.lengths.items():
                # a site without a path stands for the whole host, with an empty path too
                heads = [path[:n] for n in lengths if n <= len(path)] or (["/"] if kind == "s" and lengths and not path else [])
                for k in range(len(labels)):
                    suffix = ".".join(labels[k:])
                    for head in heads:
                        keys.append(f"{kind}{suffix}{head}")
                        owner.append(i)
            for word in {w for label in labels for w in label.split("-") if w}:
                keys.append("w" + word)
                owner.append(i)
        rule, verdict, best = [None] * len(hosts), ["allow"] * len(hosts), [(0, 0)] * len(hosts)
        for k in np.flatnonzero(found := self.probe(keys)).tolist():
            i, kind, text = owner[k], int(found[k]), keys[k][1:]
            rank = (3 if kind < 3 else 1 if kind == 3 else 2, len(text))  # rules, then sites, then words; the longest first
            if rank > best[i]:
                best[i], verdict[i] = rank, "allow" if kind in (1, 4) else "block"
                if kind < 3:
                    rule[i] = text
        return hosts, paths, rule, verdict


def _urls(pages, url_col):
    """Columns of a url's host and of its words."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rest = F.when(F.contains("u", F.lit("://")), F.substring_index(F.substring_index(F.expr("substring(u, position('://', u) + 3)"), "#", 1), "?", 1)).otherwise("")
    rows = pages.select(url.alias("u"))
    return rows.select(lower(F.substring_index(rest, "/", 1)).alias("host"), F.split(lower(F.col("u")), "[^a-z0-9]+").alias("words"))


def blocked_sites(pages, url_col="url", words=BLOCKED_WORDS, least=LEAST_URLS):
    """(verdict, site): the hosts of a table of urls with ``least`` urls or more, most of which hold a blocked word anywhere."""
    rows = _urls(pages, url_col).filter("host <> ''")
    bad = F.arrays_overlap("words", F.array(*map(F.lit, words)))
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"))
    return counts.filter((F.col("n") >= least) & (2 * F.col("bad") > F.col("n"))).select(F.lit("block").alias("verdict"), F.col("host").alias("site"))


def build_listed_index(listed, rules=RULES, words=BLOCKED_WORDS):
    """The array of ``build_index`` with the sites of a table (verdict, site), hashed, sorted and packed in Spark."""
    spark = listed.sparkSession
    few = [("r" + text, 1 if verdict == "allow" else 2) for verdict, text in rules] + [("w" + w, 3) for w in words]
    sites = listed.filter("site IS NOT NULL").select(F.concat(F.lit("s"), "site", F.when(F.contains("site", F.lit("/")), "").otherwise("/")).alias("key"), F.when(F.col("verdict") == "allow", 4).otherwise(5).alias("kind"))
    keys = sites.groupBy("key").agg(F.min("kind").cast("int").alias("kind")).unionByName(spark.createDataFrame(few, "key string, kind int"))
    tail = F.expr("char_length(key) - position('/', key) + 1")
    of = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), tail)))
    size = keys.agg(F.sum(F.octet_length("key") + 17).alias("bytes"), of((1, 2)).alias("rules"), of((4, 5)).alias("sites")).first()
    if size.bytes > MOST_BYTES:
        raise ValueError(f"listed sites take {size.bytes} bytes, more than {MOST_BYTES}")

    def digests(batches):
        for batch in batches:
            found = np.fromiter((xxhash.xxh64_intdigest(k) for k in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            # signed numbers in the order of the unsigned ones
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((found ^ np.uint64(1 << 63)).view(np.int64))], names=["key", "kind", "d"])

    def packed_ranges(batches):
        for batch in batches:
            raw = batch.column("key").cast(pa.binary()).to_pylist()
            parts = [(batch.column("d").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)).tobytes(), batch.column("kind").to_numpy().astype(np.int8).tobytes(), np.array([len(r) for r in raw], np.int64).tobytes(), b"".join(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], names=["digest", "kind", "lengths", "text"])

    ranges = keys.mapInArrow(digests, "key string, kind int, d long").orderBy("d", "key").mapInArrow(packed_ranges, "digest binary, kind binary, lengths binary, text binary").collect()
    columns = {name: [r[name] for r in ranges] for name in ("digest", "kind", "lengths", "text")}
    ranges.clear()  # each column is let go as soon as it is joined
    joined = lambda name, kind: np.frombuffer(b"".join(columns.pop(name)), kind)
    return packed({
        "digest": joined("digest", np.uint64),
        "kind": joined("kind", np.int8),
        "at": np.concatenate([[0], np.cumsum(joined("lengths", np.int64))]),
        "text": joined("text", np.uint8),
        "rule_lengths": np.array(size.rules, np.int64),
        "site_lengths": np.array(size.sites, np.int64),
    })


def judge_urls(pages, id_col="page_id", url_col="url", rules=RULES, words=BLOCKED_WORDS, listed=None):
    """id, host, path, rule and verdict of every row.

    ``listed`` is a table (verdict, site) of host or host + path prefixes; one whose packed array
    would exceed MOST_BYTES is refused.
    """
    blob = build_index(rules, words) if listed is None else build_listed_index(listed, rules, words)
    shared = pages.sparkSession.sparkContext.broadcast(blob)
    key = f"urls-{xxhash.xxh64_hexdigest(blob)}"
    src = pages.select(id_col, url_col)
    id_type = src.schema[0].dataType.simpleString()

    def run(batches):
        index = Index(mapped(key, shared))
        for batch in batches:
            columns = index.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[id_col, "host", "path", "rule", "verdict"]
            )

    return src.mapInArrow(run, f"`{id_col}` {id_type}, {SCHEMA}")


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, listed=blocked_sites(pages))


_TAIL = "split_part(split_part(substr(url, strpos(url, '://') + 3), '#', 1), '?', 1)"

_WORDS = "[" + ", ".join(f"'{w}'" for w in BLOCKED_WORDS) + "]"

ORACLE_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN {_TAIL} ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id,
         translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM u
), r(verdict, host, path) AS (
  VALUES {", ".join(f"('{v}', '{t[: t.index('/')]}', '{t[t.index('/') :]}')" for v, t in RULES)}
), f AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM p JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
  GROUP BY page_id
), b AS (
  SELECT host FROM (SELECT p.host, list_has_any(string_split_regex(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), {_WORDS}) AS bad
    FROM p JOIN pages USING (page_id) WHERE p.host <> '')
  GROUP BY host HAVING count(*) >= {LEAST_URLS} AND 2 * count(*) FILTER (bad) > count(*)
)
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN list_has_any(string_split(replace(p.host, '-', '.'), '.'), {_WORDS})
         OR EXISTS (SELECT 1 FROM b WHERE p.host = b.host OR ends_with(p.host, '.' || b.host)) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id)
"""
