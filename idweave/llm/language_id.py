"""Language identification by a byte convolutional network.

Texts are cut into fixed-length windows of UTF-8 bytes.  Each byte is embedded, filters of
several widths run over the window, the largest response of each filter is kept and a softmax
layer turns these into language probabilities.  A document's distribution is the mean of its
windows' distributions, weighted by their bytes: all windows of the whole text are scored, in
blocks of bounded size.  The network is trained in numpy on windows
drawn from a bounded sample of labelled texts.

Defined results: ``und`` with score 0 where the text is null or has no letter, and everywhere
if nothing is labelled.  Rows are judged one by one; repeated rows repeat, an empty table gives
none.  Equal probabilities: the first language in ascending order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import chunks, mapped, packed, table, unpacked, utf8_view, written

#: Bytes in a window; embedding size; filters of each width.
WINDOW, DIM, FILTERS = 160, 6, {2: 8, 3: 12, 4: 12}
#: Labelled texts of each language that the network is fitted on (a bound in expectation), and in all at most.
PER_LANGUAGE, SAMPLE = 600, 6000
#: Windows taken from each labelled text, and training passes.
WINDOWS_EACH, EPOCHS = 4, 8
UNKNOWN = "und"

_WIDEST = max(FILTERS)
_N_FILTERS = sum(FILTERS.values())
_BLOCK = 32  # windows in a numpy step


def _mask():
    """1 where a filter has weights: narrower filters leave the last bytes of the widest span unused."""
    out = np.zeros((_WIDEST, DIM, _N_FILTERS), np.float32)
    at = 0
    for width, n in FILTERS.items():
        out[:width, :, at : at + n] = 1
        at += n
    return out.reshape(_WIDEST * DIM, _N_FILTERS)


def _spans(windows, embedding):
    """(windows * positions, widest * DIM): the embedded bytes under the filters at each position."""
    n, length = windows.shape
    padded = np.zeros((n, length + _WIDEST - 1), np.uint8)
    padded[:, :length] = windows
    e = embedding[padded]
    out = np.empty((n, length, _WIDEST, DIM), np.float32)
    for k in range(_WIDEST):
        out[:, :, k] = e[:, k : k + length]
    return out.reshape(n * length, _WIDEST * DIM)


def _pooled(windows, net):
    """Largest response of each filter in each window, after a ramp, and where it was."""
    spans = _spans(windows, net["embedding"])
    responses = (spans @ net["filters"]).reshape(len(windows), -1, _N_FILTERS)
    return spans, responses


def log_probabilities(windows, net):
    """(windows, languages), computed in blocks that stay in cache."""
    out = np.empty((len(windows), len(net["out_bias"])), np.float32)
    for i in range(0, len(windows), _BLOCK):
        _, responses = _pooled(windows[i : i + _BLOCK], net)
        hidden = np.maximum(responses.max(1) + net["bias"], 0)
        z = hidden @ net["out"] + net["out_bias"]
        z -= z.max(1, keepdims=True)
        out[i : i + _BLOCK] = z - np.log(np.exp(z).sum(1, keepdims=True))
    return out


def train(windows, labels, n_languages, epochs=EPOCHS, seed=7):
    """Adam on cross entropy; classes weigh the same."""
    rng = np.random.default_rng(seed)
    mask = _mask()
    net = {
        "embedding": rng.normal(0, 0.5, (256, DIM)),
        "filters": rng.normal(0, 0.3, mask.shape) * mask,
        "bias": np.zeros(_N_FILTERS),
        "out": rng.normal(0, 0.3, (_N_FILTERS, n_languages)),
        "out_bias": np.zeros(n_languages),
    }
    net = {k: v.astype(np.float32) for k, v in net.items()}
    net["embedding"][0] = 0  # padding
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    weight = len(labels) / np.maximum(np.bincount(labels, minlength=n_languages), 1) / n_languages
    step, rows = 0, np.arange(_WIDEST)
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        order = rng.permutation(len(labels))
        for i in range(0, len(order), 64):
            pick = order[i : i + 64]
            x, y = windows[pick], labels[pick]
            n, length = x.shape
            spans, responses = _pooled(x, net)
            best = responses.argmax(1)  # (n, filters)
            peak = np.take_along_axis(responses, best[:, None], 1)[:, 0] + net["bias"]
            hidden = np.maximum(peak, 0)
            z = hidden @ net["out"] + net["out_bias"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            dz = p * (weight[y] / n)[:, None]
            dh = (dz @ net["out"].T) * (peak > 0)
            at = (np.arange(n)[:, None] * length + best).ravel()
            own = spans[at].reshape(n, _N_FILTERS, -1)
            d_filters = np.einsum("nfk,nf->kf", own, dh) * mask
            d_spans = (dh[:, :, None] * net["filters"].T[None]).reshape(n * _N_FILTERS, _WIDEST, DIM)
            padded = np.zeros((n, length + _WIDEST - 1), np.uint8)
            padded[:, :length] = x
            which = padded.ravel()[((np.arange(n)[:, None] * padded.shape[1] + best).ravel()[:, None] + rows)]
            d_embedding = np.zeros_like(net["embedding"])
            np.add.at(d_embedding, which.ravel(), d_spans.reshape(-1, DIM))
            d_embedding[0] = 0
            grads = {"embedding": d_embedding, "filters": d_filters, "bias": dh.sum(0), "out": hidden.T @ dz, "out_bias": dz.sum(0)}
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in net.items()}


def cut_windows(data, offsets):
    """(windows, row, bytes used) of all texts: every byte is in exactly one window."""
    length = np.diff(offsets)
    each = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), each)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[row] + nth * WINDOW
    used = np.minimum(offsets[row + 1] - start, WINDOW)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(row) else np.zeros((0, WINDOW), np.uint8), row, used


def classify(texts, net):
    """(probabilities of each language) for each text of an Arrow column; zeros for empty texts."""
    n_languages = len(net["out_bias"])
    sums, total = np.zeros((len(texts), n_languages)), np.zeros(len(texts))
    data, offsets, _ = utf8_view(texts)
    for i, j in chunks(offsets, 1 << 20):
        own = offsets[i : j + 1]
        windows, row, used = cut_windows(data[own[0] : own[-1]], own - own[0])
        shares = np.exp(log_probabilities(windows, net)) * used[:, None]
        for k in range(n_languages):
            sums[i:j, k] = np.bincount(row, weights=shares[:, k], minlength=j - i)
        total[i:j] = own[1:] - own[:-1]
    return np.minimum(sums / np.maximum(total, 1)[:, None], 1.0)


def labelled_windows(docs, id_col, text_col, lang_col):
    """Windows and labels of the training sample, collected: SAMPLE * WINDOWS_EACH * WINDOW bytes at most."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # written, so that Spark knows its size and broadcasts it only if it is small
    counts = written(docs.sparkSession, rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")), "languages")
    picked = rows.withColumnRenamed(lang_col, "lang") if lang_col != "lang" else rows
    place = F.xxhash64(F.col(id_col).cast("string"), text_col)
    draw = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    raw = F.encode(F.col(text_col), "UTF-8")
    # evenly spread windows of the whole text, aligned as in prediction
    n_windows = F.ceil(F.octet_length(raw) / F.lit(float(WINDOW)))
    spread = [F.substring(raw, (F.floor(n_windows * F.lit(k / WINDOWS_EACH)) * WINDOW + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS_EACH)]
    picked = picked.select("lang", draw.alias("draw"), place.alias("h"), F.array_distinct(F.array(*spread)).alias("w"))
    picked = picked.join(counts, "lang").filter(F.col("draw") < F.lit(float(PER_LANGUAGE)) / F.col("n"))
    found = picked.select("lang", "h", "w").orderBy("h", "lang").limit(SAMPLE).collect()
    langs = sorted({r.lang for r in found})
    number = {k: i for i, k in enumerate(langs)}
    pairs = [(w, number[r.lang]) for r in found for w in r.w if len(w)]
    windows = np.zeros((len(pairs), WINDOW), np.uint8)
    for i, (w, _) in enumerate(pairs):
        windows[i, : len(w)] = np.frombuffer(bytes(w), np.uint8)
    return windows, np.array([y for _, y in pairs], np.int64), langs


def fit(docs, id_col="doc_id", text_col="text", lang_col="lang"):
    """(packed network, languages) trained on ``docs``."""
    windows, labels, langs = labelled_windows(docs, id_col, text_col, lang_col)
    if not len(labels):
        return None, []
    return packed(train(windows, labels, len(langs))), langs


def _mapper(src, model, text_at, emit, schema):
    net_bytes, langs = model
    shared = src.sparkSession.sparkContext.broadcast(net_bytes or b"")
    key = f"language-{hash(net_bytes)}"

    def run(batches):
        net = unpacked(mapped(key, shared)) if langs else None
        for batch in batches:
            if not langs:
                yield emit(batch, np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows))
                continue
            p = classify(batch.column(text_at), net)
            best = p.argmax(1)
            lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in batch.column(text_at).to_pylist()], bool)
            names = np.where(lettered, np.array(langs, object)[best], UNKNOWN)
            yield emit(batch, names, np.where(lettered, p[np.arange(len(p)), best], 0.0))

    return src.mapInArrow(run, schema)


def detect_language(docs, model, id_col="doc_id", text_col="text", keep=()):
    """id, the columns ``keep``, lang_pred and score of every row."""
    src = docs.select(id_col, text_col, *keep)
    fields = [f"`{src.schema[i].name}` {src.schema[i].dataType.simpleString()}" for i in (0, *range(2, len(src.columns)))]

    def emit(batch, names, scores):
        own = [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns))]
        return pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    return _mapper(src, model, 1, emit, ", ".join(fields) + ", lang_pred string, score double")


def keep_identified(docs, model, least=0.5, text_col="text"):
    """Rows with a known language whose score is at least ``least``, with all their columns."""

    def emit(batch, names, scores):
        return batch.filter(pa.array((names != UNKNOWN) & (scores >= least)))

    return _mapper(docs, model, docs.columns.index(text_col), emit, docs.schema)


def held_out(id_col="doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 2 mod 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    out = detect_language(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
