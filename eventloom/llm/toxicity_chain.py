"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on a text's words; the models of later
categories also get the probabilities of the earlier ones. In training these probabilities come from
out-of-fold predictions, so a later model never sees an earlier one's answers on texts that taught it.

Features are the distinct lower-cased words of the whole text and their four-letter stretches, hashed to
COLUMNS columns, each weighed by the log ratio of its class-conditional frequencies (columns in fewer than
MIN_DOCS training texts weigh nothing); the models are logistic regressions on them, fitted by full-batch gradient steps in numpy on a
bounded sample of labelled texts. The decision threshold of a category is the one with the best F1 on
the out-of-fold predictions.

Defined cases: a null or empty text has no words and gets the models' base probability, but is never
flagged; labels that are null are left out; a category without both answers in the sample is never
flagged (probability 0); rows that repeat are scored alike; of labels that repeat an id the smallest counts; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import bound_batches

COLUMNS = 1 << 18
#: Words whose columns a task remembers.
REMEMBER = 100_000
#: Labelled texts in the training sample; each teaches with all its columns (at most COLUMNS).
SAMPLE = 4000
MIN_DOCS = 8
FOLDS = 3
STEPS = 40
RIDGE = 1e-4

WORD = re.compile(r"[^\W\d_]+")


class Features:
    """Columns of a text: its distinct words and the distinct four-letter stretches of them, edges included."""

    def __init__(self):
        self.memo: dict[str, bytes] = {}

    def of_word(self, word: str) -> bytes:
        """The word's columns, four bytes each: a bytes object is a fifth of a list of ints."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > REMEMBER:
                self.memo.clear()
            edged = f"^{word}$"
            parts = [word, *["#" + edged[i:i + 4] for i in range(len(edged) - 3)]]
            got = self.memo[word] = array("i", [zlib.crc32(x.encode("utf-8", "surrogatepass")) % COLUMNS for x in parts]).tobytes()
        return got

    def __call__(self, text: str | None):
        """Sorted distinct columns."""
        words = set(WORD.findall((text or "").lower()))
        return np.unique(np.frombuffer(b"".join(map(self.of_word, words)), np.int32)).astype(np.int64)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Sparse rows: columns of row i are ids[first[i]:first[i] + n[i]]."""

    def __init__(self, lists):
        self.n = np.array([len(x) for x in lists], np.int64)
        self.ids = np.concatenate(lists) if len(lists) else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(lists), dtype=np.int32), self.n)

    def sums(self, weights):
        return np.bincount(self.owner, weights=weights[self.ids], minlength=len(self.n))


def fit_one(rows: Rows, dense, y, use):
    """Weights of one category on the rows marked in `use`: (word weights, dense weights, bias)."""
    mask = use[rows.owner]
    ids, owner = rows.ids[mask], rows.owner[mask]
    pos, neg = max(1, int(y[use].sum())), max(1, int((1 - y[use]).sum()))
    with_pos = np.bincount(ids[y[owner] == 1], minlength=COLUMNS)
    with_neg = np.bincount(ids[y[owner] == 0], minlength=COLUMNS)
    ratio = np.log((with_pos + 0.5) / (pos + 1)) - np.log((with_neg + 0.5) / (neg + 1))
    ratio[with_pos + with_neg < MIN_DOCS] = 0
    # a log ratio within two standard errors of none says nothing
    error = np.sqrt(1 / (with_pos + 0.5) + 1 / (with_neg + 0.5))
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - 2 * error, 0)
    live = ratio[ids] != 0
    ids, owner = ids[live], owner[live]
    value = ratio[ids]
    n = len(y)
    w, v, b = np.ones(COLUMNS) * 0.5, np.zeros(dense.shape[1]), float(np.log(pos / neg))
    target, total = y * use, float(use.sum())
    momentum = [np.zeros(COLUMNS), np.zeros(dense.shape[1]), 0.0]
    size = [np.zeros(COLUMNS), np.zeros(dense.shape[1]), 0.0]
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, weights=w[ids] * value, minlength=n) + dense @ v + b
        g = (_sigmoid(z) * use - target) / total
        grads = [np.bincount(ids, weights=g[owner] * value, minlength=COLUMNS) + RIDGE * w, dense.T @ g + RIDGE * v, float(g.sum())]
        for k, grad in enumerate(grads):
            momentum[k] = 0.9 * momentum[k] + 0.1 * grad
            size[k] = 0.99 * size[k] + 0.01 * grad * grad
        move = [0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-9) for m, s in zip(momentum, size)]
        w, v, b = w - move[0], v - move[1], b - move[2]
    return (w * ratio).astype(np.float32), v, b


def best_threshold(p, y) -> float:
    """Between the probabilities where F1 is best."""
    by = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[by])
    f1 = 2 * hits / (np.arange(1, len(by) + 1) + max(1, y.sum()))
    k = int(f1.argmax())
    nxt = p[by[k + 1]] if k + 1 < len(by) else 0.0
    return float((p[by[k]] + nxt) / 2)


def fit_chain(lists, labels, categories, folds: int = FOLDS):
    """Models in the chain's order; labels: (texts x categories) of 0, 1 or nan."""
    rows = Rows(lists)
    fold = np.arange(len(lists)) % folds
    dense = np.zeros((len(lists), 0))
    chain = []
    for c, name in enumerate(categories):
        known = ~np.isnan(labels[:, c])
        y = np.where(known, labels[:, c], 0).astype(np.int64)
        if not known.any() or len(set(y[known])) < 2:
            chain.append((name, None, None, 0.0, 2.0))
            dense = np.hstack([dense, np.zeros((len(lists), 1))])
            continue
        out = np.zeros(len(lists))
        for k in range(folds):
            w, v, b = fit_one(rows, dense, y, known & (fold != k))
            here = fold == k
            out[here] = _sigmoid(rows.sums(w) + dense @ v + b)[here]
        chain.append((name, *fit_one(rows, dense, y, known), best_threshold(out[known], y[known])))
        dense = np.hstack([dense, out[:, None]])
    return chain


def scores(chain, lists):
    """(texts x categories) probabilities, each category fed with the earlier ones."""
    rows, dense = Rows(lists), np.zeros((len(lists), 0))
    for _, w, v, b, _ in chain:
        p = np.zeros(len(lists)) if w is None else _sigmoid(rows.sums(w) + dense @ v + b)
        dense = np.hstack([dense, p[:, None]])
    return dense


def _word_rows(batches):
    import pyarrow as pa
    features = Features()
    for batch in batches:
        lists = [features(t) for t in batch.column(0).to_pylist()]
        arrays = [pa.array([x.astype(np.int32).tobytes() for x in lists], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays + [batch.column(1), batch.column(2)], ["words", "key", "labels"])


def train(docs: DataFrame, labels: DataFrame, categories, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """The chain, fitted on at most about `sample` labelled texts. categories: [(name, SQL condition on labels)]."""
    keyed = labels.filter(F.col(id_col).isNotNull())
    total = max(1, keyed.count())
    scale = 1 << 30
    answers = F.array(*[F.expr(f"cast(({sql}) as double)") for _, sql in categories])
    # of repeated labels the smallest counts; at most 2 * sample small rows
    chosen = (keyed.filter(F.pmod(F.xxhash64(id_col), F.lit(scale)) < min(scale, scale * sample // total + 1))
              .groupBy(F.col(id_col).alias("label_id")).agg(F.min(answers).alias("labels"))
              .orderBy(F.xxhash64("label_id"), "label_id").limit(2 * sample))
    texts = (docs.select(F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("t"))
             .join(F.broadcast(chosen), "label_id").select("t", "label_id", "labels"))
    kind = dict(docs.dtypes)[id_col]
    got = texts.mapInArrow(_word_rows, f"words binary, key {kind}, labels array<double>")
    got = got.orderBy(F.xxhash64("key"), F.xxhash64("words")).limit(2 * sample).collect()
    got.sort(key=lambda r: (r["key"], bytes(r["words"])))
    lists = [np.frombuffer(r["words"], np.int32) for r in got]
    answers = np.array([[np.nan if x is None else x for x in r["labels"]] for r in got], float).reshape(len(got), len(categories))
    return fit_chain(lists, answers, [n for n, _ in categories])


def _score_rows(chain):
    def run(batches):
        import pyarrow as pa
        features = Features()
        for batch in batches:
            lists = [features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            p = scores(chain, lists)
            flags = [[bool(len(x) and q[c] >= chain[c][4]) for c in range(len(chain))] for x, q in zip(lists, p)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(flags, pa.list_(pa.bool_()))],
                                             ["key", "p", "flags"])
    return run


def score_toxicity(docs: DataFrame, chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, then p_<category> and is_<category> for each category of the chain."""
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("t"))
    out = rows.mapInArrow(_score_rows(chain), f"key {kind}, p array<double>, flags array<boolean>")
    cols = [F.col("key").alias(id_col)]
    for i, c in enumerate(chain):
        cols += [F.col("p")[i].alias(f"p_{c[0]}"), F.col("flags")[i].alias(f"is_{c[0]}")]
    return out.select(*cols)


def drop_toxic(docs: DataFrame, chain, category: str, text_col: str = "text") -> DataFrame:
    """docs without the rows flagged in that category; all columns stay, nothing is shuffled."""
    bound_batches(docs.sparkSession)
    at = [c[0] for c in chain].index(category)
    limit = chain[at][4]
    names = docs.columns
    place = names.index(text_col)

    def run(batches):
        import pyarrow as pa
        features = Features()
        for batch in batches:
            lists = [features(t) for t in batch.column(place).to_pylist()]
            p = scores(chain, lists)[:, at]
            yield batch.filter(pa.array([not (len(x) and q >= limit) for x, q in zip(lists, p)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
