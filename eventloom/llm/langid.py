"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased and everything but letters becomes a word edge; its subwords are the letter pairs
and triples of its words with their edges. Each subword is hashed to one of BUCKETS embedding rows; a
text is the mean of its rows, and a linear softmax on it gives the language. Embeddings and softmax are
trained by stochastic gradient descent in numpy, on a bounded sample of labelled texts; part of it is held
back to calibrate the softmax (a temperature) and to set the confidence below which a prediction is
rejected. Prediction runs over whole texts; as mean and softmax are linear, the product of embeddings and
softmax weights is looked up per subword.

Defined cases: a text that is null or has no letter is `und` with score 0 and not accepted; labels that
are null are not learned; without any labelled text everything is `und`; rows that repeat are predicted
alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import bound_batches, row_key
from eventloom.llm.shingles import mix

BUCKETS = 1 << 15
DIM = 16
#: The training sample: texts of each language, and the largest size of one text in it (code points).
TEXTS_PER_LANG = 400
LARGEST = 20_000
#: Languages learned, the most frequent ones first.
MOST_LANGS = 512
#: A training example is a stretch of so many code points of a sampled text.
STRETCH = 300
EPOCHS = 3
BATCH = 128
RATE = 0.5
#: Share of right answers wanted among the accepted ones.
PRECISION = 0.99
UNKNOWN = "und"


def letter_table():
    """For every code point: is it a letter?"""
    import sys
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def subwords(texts, letters, buckets: int = BUCKETS):
    """(bucket of every subword, text of every subword, letters of every text); texts: lower-cased strings."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # a text's own newline is no letter either, so texts never share a subword
    real = letters[codes.astype(np.int64)]
    codes = np.where(real, codes, np.uint64(1))
    text = np.repeat(np.arange(len(texts)), sizes)
    prev = np.concatenate([[False], real[:-1]])
    keep = real | prev  # a letter, or the edge behind a word
    at = np.flatnonzero(keep)
    c0, r0 = codes[at], real[at]
    c1 = np.where(at >= 1, codes[at - 1], np.uint64(1))
    r1 = np.where(at >= 1, real[at - 1], False)
    c2 = np.where(at >= 2, codes[at - 2], np.uint64(1))
    big = np.uint64(0x200000)
    pairs = mix((c1 * big + c0) * np.uint64(2))
    triples = mix(((c2 * big + c1) * big + c0) * np.uint64(2) + np.uint64(1))
    three = r1  # the middle one is a letter
    ids = np.concatenate([pairs, triples[three]]) % np.uint64(buckets)
    owner = np.concatenate([text[at], text[at][three]])
    return ids.astype(np.int64), owner, np.bincount(text[at][r0], minlength=len(texts))


def _softmax(z):
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit(texts, labels, letters, seed: int = 3):
    """Model of the sampled texts: {langs, table (bucket x lang), bias, temperature, threshold}."""
    langs = sorted(set(labels))
    if not langs:
        return {"langs": [], "table": np.zeros((BUCKETS, 0), np.float32), "bias": np.zeros(0), "threshold": 1.0}
    number = {x: i for i, x in enumerate(langs)}
    rng = np.random.default_rng(seed)
    stretches, y, group = [], [], []
    for k, (t, lang) in enumerate(zip(texts, labels)):
        t = t.lower()
        for i in range(0, len(t), STRETCH):
            stretches.append(t[i:i + STRETCH]), y.append(number[lang]), group.append(k)
    y, held = np.array(y), np.array(group) % 5 == 0
    ids, owner, _ = subwords(stretches, letters)
    order = np.argsort(owner, kind="stable")
    ids, counts = ids[order], np.bincount(owner, minlength=len(stretches))
    first = np.cumsum(counts) - counts
    emb = (rng.standard_normal((BUCKETS, DIM)) * 0.1).astype(np.float32)
    w, b = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)

    def gather(rows):
        n = counts[rows]
        at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return ids[at], np.repeat(np.arange(len(rows)), n), np.maximum(n, 1).astype(np.float32)

    def means(i, o, n, rows):
        out = np.stack([np.bincount(o, weights=emb[i, d], minlength=rows) for d in range(DIM)], 1)
        return (out / n[:, None]).astype(np.float32)

    train = np.flatnonzero(~held & (counts > 0))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        rng.shuffle(train)
        for k in range(0, len(train), BATCH):
            rows = train[k:k + BATCH]
            i, o, n = gather(rows)
            x = means(i, o, n, len(rows))
            g = _softmax(x @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            back = (g @ w.T) / n[:, None]
            w -= rate * (x.T @ g) / len(rows)
            b -= rate * g.mean(0)
            by = np.argsort(i, kind="stable")
            si, so = i[by], o[by]
            starts = np.flatnonzero(np.concatenate([[True], si[1:] != si[:-1]]))
            emb[si[starts]] -= rate * 20 * np.add.reduceat(back[so], starts, axis=0)
    table = emb @ w
    # calibration on the texts held back: the temperature with the least log loss, then the threshold
    rows = np.flatnonzero(held & (counts > 0))
    if not len(rows):
        rows = train
    i, o, n = gather(rows)
    z = np.stack([np.bincount(o, weights=table[i, c], minlength=len(rows)) / n for c in range(len(langs))], 1) + b
    best = min((-np.log(np.maximum(_softmax(z / t)[np.arange(len(rows)), y[rows]], 1e-12)).mean(), t) for t in np.geomspace(0.05, 5, 41))
    p = _softmax(z / best[1])
    sure, right = p.max(1), p.argmax(1) == y[rows]
    by = np.argsort(-sure, kind="stable")
    precise = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= PRECISION
    threshold = float(sure[by][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return {"langs": langs, "table": (table / best[1]).astype(np.float32), "bias": b / best[1], "threshold": threshold}


def predict(texts, model, letters):
    """(lang, score, accepted) lists for a list of strings or nulls."""
    langs = model["langs"]
    lower = [(t or "").lower() for t in texts]
    out, scores = [UNKNOWN] * len(lower), [0.0] * len(lower)
    first = 0
    while first < len(lower) and langs:
        last, chars = first, 0
        while last < len(lower) and (last == first or chars + len(lower[last]) < 1_000_000):
            chars += len(lower[last])
            last += 1
        ids, owner, n_letters = subwords(lower[first:last], letters)
        m = last - first
        n = np.maximum(np.bincount(owner, minlength=m), 1)
        z = np.stack([np.bincount(owner, weights=model["table"][ids, c], minlength=m) / n for c in range(len(langs))], 1) + model["bias"]
        p = _softmax(z)
        at, top = p.argmax(1), p.max(1)
        for k in np.flatnonzero(n_letters):
            out[first + k], scores[first + k] = langs[at[k]], float(top[k])
        first = last
    return out, scores, [s >= model["threshold"] and x != UNKNOWN for x, s in zip(out, scores)]


def training_sample(docs: DataFrame, learnable: Column, id_col: str, text_col: str, lang_col: str):
    """About TEXTS_PER_LANG texts of each of the MOST_LANGS most frequent languages, chosen by a hash of the
    row: (texts, labels), bounded by MOST_LANGS * 2 * TEXTS_PER_LANG rows of LARGEST code points."""
    rows = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) <= LARGEST))
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()
    if not counts:
        return [], []
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(scale, scale * TEXTS_PER_LANG // r["n"] + 1))])
    picked = rows.filter(F.pmod(row_key(F.col(id_col), F.col(text_col)), F.lit(scale)) < F.try_element_at(share, F.col(lang_col)))
    got = picked.select(F.col(text_col).alias("t"), F.col(lang_col).alias("y")).limit(2 * TEXTS_PER_LANG * len(counts)).collect()
    got.sort()
    return [r["t"] for r in got], [r["y"] for r in got]


def _predict_rows(model):
    def run(batches):
        import pyarrow as pa
        letters = letter_table()
        for batch in batches:
            lang, score, sure = predict(batch.column(2).to_pylist(), model, letters)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())],
                                             ["id", "held_out", "lang_pred", "score", "accepted"])
    return run


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score, accepted (score reaches the calibrated
    threshold). Rows for which held_out holds teach nothing."""
    bound_batches(docs.sparkSession)
    texts, labels = training_sample(docs, ~held_out, id_col, text_col, lang_col)
    model = fit(texts, labels, letter_table())
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = dict(docs.dtypes)[id_col]
    out = rows.mapInArrow(_predict_rows(model), f"id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
    return out.withColumnRenamed("id", id_col)


def one_third(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
