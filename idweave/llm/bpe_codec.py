"""Byte-level BPE encoding and decoding through a transducer lexicon.

Spark counts the words of all rows; the frequent ones are compiled, with their token ids, into
a minimal acyclic transducer: states that share suffixes are merged, and the outputs of the
arcs on a word's path add up to the word's number, which finds its ids.  Workers memory-map the
automaton and walk all new words of a batch through it at once; words that it lacks are merged
exactly by the vocabulary's ranks.  Decoding joins the tokens' bytes again.

Defined results: a null text counts as empty and has no tokens (both digests are of nothing).
Rows are encoded one by one; repeated rows repeat, an empty table gives none, and any length of
text or word is taken whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from .common import mapped, packed, table, unpacked

#: A word is frequent if it occurs once in every (bytes of text / MOST_WORDS) at least: there are at most MOST_WORDS such words.
MOST_WORDS = 1 << 19
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 300_000
#: Characters that are split into words at a time.
BLOCK_CHARS = 1 << 20

#: The split of byte-level BPE (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = 1 << 60


def byte_alphabet():
    """Character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Vocabulary:
    """Token bytes, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, text):
        spec = json.loads(text)
        model, alphabet = spec["model"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            if token not in self.special:
                self.tokens[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.of_byte = [ids[c] for c in alphabet]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(ids[a] << 20 | ids[b], rank << 20 | ids[a + b])
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.ranks = np.array([self.merges[k] for k in self.pairs.tolist()], np.int64)

    def _rank(self, left, right):
        wanted = left << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.ranks[at], _NONE)

    def merge_all(self, words):
        """(ids of all words one after the other, count of each): every round merges one pair of each unfinished word."""
        n = len(words)
        long = {k: self._merge_long(w) for k, w in enumerate(words) if len(w) > 256}
        sizes = np.array([0 if k in long else len(w) for k, w in enumerate(words)], np.int64)
        data = np.frombuffer(b"".join(w for k, w in enumerate(words) if k not in long), np.uint8)
        ids, own = np.array(self.of_byte, np.int64)[data], np.repeat(np.arange(n), sizes)
        rank = np.full(len(ids), _NONE)
        rank[:-1] = np.where(own[1:] == own[:-1], self._rank(ids[:-1], ids[1:]), _NONE)
        done = [(np.repeat(k, len(x)), np.array(x, np.int64)) for k, x in long.items()]
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            least = np.minimum.reduceat(rank, first)
            least_here = np.repeat(least, np.diff(np.append(first, len(ids))))
            if (least == _NONE).any():
                over = least_here == _NONE
                done.append((own[over], ids[over]))
                ids, own, rank, least_here = ids[~over], own[~over], rank[~over], least_here[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least_here)
            at = at[np.concatenate([[True], own[at[1:]] != own[at[:-1]]])]
            ids[at] = rank[at] & 0xFFFFF
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, own, rank = ids[stays], own[stays], rank[stays]
            at -= np.arange(len(at))
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(ids) - 1)
                joined = (own[left] == own[right]) & (left < right)
                rank[left] = np.where(joined, self._rank(ids[left], ids[right]), _NONE)
        if not done:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        own, ids = (np.concatenate(x) for x in zip(*done))
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=n)

    def merge(self, word):
        """Ids of one word's bytes: the pair of least rank is merged until none is left."""
        if len(word) > 48:
            return self._merge_long(word)
        ids = [self.of_byte[b] for b in word]
        rank = self.merges.get
        while len(ids) > 1:
            ranks = [rank(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
            least = min(ranks)
            if least == _NONE:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i < n - 1 and ranks[i] == least:
                    out.append(least & 0xFFFFF)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, word):
        ids = [self.of_byte[b] for b in word]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.merges.get
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = m & 0xFFFFF, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := rank(ids[left] << 20 | ids[right])) is not None:
                    heapq.heappush(heap, (m, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


# ---------------------------------------------------------------- the transducer


def compile_words(words, outputs):
    """Arrays of the minimal acyclic transducer of ``words`` (distinct byte strings) with their id lists.

    Words enter in sorted order; as soon as a branch is finished, each of its states is replaced
    by an equal one if there is any.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    arcs, final, known = [{}], [False], {}

    def settle(path, keep):
        while len(path) > keep:
            parent, byte, child = path.pop()
            same = (final[child], *arcs[child].items())
            if (twin := known.get(same)) is not None:
                arcs[parent][byte] = twin
            else:
                known[same] = child

    path, last = [], b""
    for k in order:
        word, shared = words[k], 0
        for a, b in zip(word, last):
            if a != b:
                break
            shared += 1
        settle(path, shared)
        here = path[-1][2] if path else 0
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[here][byte] = len(arcs) - 1
            path.append((here, byte, len(arcs) - 1))
            here = len(arcs) - 1
        final[here] = True
        last = word
    settle(path, 0)

    number, below, stack = {}, {}, [(0, False)]
    while stack:  # words below each state, children first
        state, ready = stack.pop()
        if ready:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            number[state] = len(number)
        elif state not in below:
            stack.append((state, True))
            stack += [(t, False) for t in arcs[state].values() if t not in below]
    number = {s: i for i, s in enumerate(below)}
    key, target, out = [], [], []
    for state in below:
        passed = int(final[state])
        for byte in sorted(arcs[state]):
            key.append(number[state] << 8 | byte)
            target.append(number[arcs[state][byte]])
            out.append(passed)
            passed += below[arcs[state][byte]]
    by_key = np.argsort(np.array(key, np.int64)) if key else np.zeros(0, np.int64)
    listed = [outputs[k] for k in order]
    return {
        "key": np.array(key, np.int64)[by_key],
        "target": np.array(target, np.int32)[by_key],
        "out": np.array(out, np.int32)[by_key],
        "final": np.array([final[s] for s in below], bool),
        "root": np.array([number[0]], np.int64),
        "at": np.cumsum([0] + [len(x) for x in listed], dtype=np.int64),
        "ids": np.array([i for x in listed for i in x], np.uint32),
    }


def look_up(lexicon, data, offsets):
    """Number of each word in the lexicon, -1 if it is not there; all words walk together."""
    n = len(offsets) - 1
    key, target, out = lexicon["key"], lexicon["target"], lexicon["out"]
    if not len(key):
        return np.full(n, -1, np.int64)
    at, end = offsets[:-1].copy(), offsets[1:]
    state, number = np.full(n, lexicon["root"][0]), np.zeros(n, np.int64)
    going = np.flatnonzero(at < end)
    while len(going):
        wanted = state[going] << 8 | data[at[going]]
        arc = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        found = key[arc] == wanted
        state[going[~found]] = -1
        going, arc = going[found], arc[found]
        state[going] = target[arc]
        number[going] += out[arc]
        at[going] += 1
        going = going[at[going] < end[going]]
    ok = (state >= 0) & lexicon["final"][np.maximum(state, 0)]
    return np.where(ok, number, -1)


# ---------------------------------------------------------------- encoding


def _ragged(start, size):
    """Positions start[k], start[k] + 1, ... (size[k] of them) of all k, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Encodes and decodes blocks of texts with one mapped lexicon."""

    def __init__(self, vocabulary, lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.find = regex.compile(SPLIT).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else None
        self.token_at = np.cumsum([0] + [len(t) for t in vocabulary.tokens], dtype=np.int64)
        self.token_bytes = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.forget()

    def forget(self):
        self.codes = {}
        self.size, self.used = np.zeros(1 << 12, np.int64), 0
        self.start, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)
        for word, i in self.vocabulary.special.items():
            self._learn({("special", word): 0}, given=[[i]])

    def _learn(self, fresh, given=None):
        """Ids of new words: through the lexicon, else by merging."""
        words = list(fresh)
        if given is None:
            raw = [w.encode() for w in words]
            offsets = np.cumsum([0] + [len(r) for r in raw], dtype=np.int64)
            number = look_up(self.lexicon, np.frombuffer(b"".join(raw), np.uint8), offsets)
            known, unseen = np.flatnonzero(number >= 0), np.flatnonzero(number < 0)
            words = [words[k] for k in known.tolist()] + [words[k] for k in unseen.tolist()]
            merged, counts = self.vocabulary.merge_all([raw[k] for k in unseen.tolist()])
            at = self.lexicon["at"]
            sizes = np.concatenate([at[number[known] + 1] - at[number[known]], counts])
            listed = np.concatenate([self.lexicon["ids"][_ragged(at[number[known]], sizes[: len(known)])], merged])
        else:
            sizes, listed = np.array([len(g) for g in given], np.int64), np.concatenate(given)
        first = len(self.codes)
        self.codes.update(zip(words, range(first, first + len(words))))
        total = int(sizes.sum())
        while len(self.size) < len(self.codes):
            self.size, self.start = np.resize(self.size, 2 * len(self.size)), np.resize(self.start, 2 * len(self.start))
        while len(self.ids) < self.used + total:
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.size[first : len(self.codes)] = sizes
        self.start[first : len(self.codes)] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = listed
        self.used += total

    def words(self, text):
        """The text's words; special strings are marked."""
        if self.split_special is None or not any(s in text for s in self.vocabulary.special):
            return self.find(text)
        out = []
        for k, part in enumerate(self.split_special(text)):
            out += [("special", part)] if k % 2 else self.find(part)
        return out

    def encode(self, texts):
        """(ids of all texts, offsets of each text)."""
        if len(self.codes) > REMEMBERED:
            self.forget()
        each = [self.words(t) if t else [] for t in texts]
        flat = [w for words in each for w in words]
        fresh = set(flat).difference(self.codes)
        if fresh:
            self._learn(dict.fromkeys(fresh))
        code = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        size = self.size[code]
        bounds = np.cumsum([0] + [len(words) for words in each])
        return self.ids[_ragged(self.start[code], size)], np.concatenate([[0], np.cumsum(size)])[bounds]

    def decode(self, ids, offsets):
        """The texts of ids[offsets[k]:offsets[k + 1]]."""
        size = np.diff(self.token_at)[ids]
        data = self.token_bytes[_ragged(self.token_at[ids], size)].tobytes()
        at = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def frequent_words(docs, text_col="text", most=MOST_WORDS):
    """Words of letters, with their leading space, that hold their share of all text; ``most`` at most."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first().n
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r" ?\p{L}+"), F.lit(0))).alias("word"))
    counts = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, -(-total // most)))
    return sorted(r.word for r in counts.select("word").collect())


def _blocks(texts):
    i, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield i, texts[i : k + 1]
            i, size = k + 1, 0
    if i < len(texts):
        yield i, texts[i:]


def code_texts(docs, path, id_col="doc_id", text_col="text", most_words=MOST_WORDS, keep_ids=False, keep_text=False):
    """id, n_tokens and the digests of ids and decoded text of every row; on request ids and text themselves.

    ``path`` is the vocabulary file, read on the driver and broadcast (its size does not depend on the data).
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    vocabulary = Vocabulary(spec)
    words = frequent_words(docs, text_col, most_words)
    raw = [w.encode() for w in words]
    blob = packed(compile_words(raw, [vocabulary.merge(r) for r in raw]))
    sc = docs.sparkSession.sparkContext
    shared, shared_spec, key = sc.broadcast(blob), sc.broadcast(spec), f"bpe-{hash((blob, path))}"
    src = docs.select(id_col, text_col)
    more = [("ids", "array<int>")] * keep_ids + [("decoded", "string")] * keep_text
    schema = f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", {n} {t}" for n, t in more)

    def run(batches):
        codec = Codec(Vocabulary(shared_spec.value), unpacked(mapped(key, shared)))
        for batch in batches:
            out = [[] for _ in range(3 + len(more))]
            for _, texts in _blocks(batch.column(1).to_pylist()):
                ids, at = codec.encode(texts)
                decoded = codec.decode(ids, at)
                little = ids.astype("<u4").tobytes()
                out[0] += np.diff(at).tolist()
                out[1] += [hashlib.sha256(little[4 * a : 4 * b]).hexdigest() for a, b in zip(at.tolist(), at[1:].tolist())]
                out[2] += [hashlib.sha256(t.encode()).hexdigest() for t in decoded]
                if keep_ids:
                    out[3] += [ids[a:b].astype(np.int32) for a, b in zip(at, at[1:])]
                if keep_text:
                    out[-1] += decoded
            kinds = [pa.int64(), pa.string(), pa.string(), *(pa.list_(pa.int32()) if n == "ids" else pa.string() for n, _ in more)]
            columns = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(n for n, _ in more)])

    return src.mapInArrow(run, schema)


def query(spark, sf_dir):
    import public_tokenizers

    return code_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
