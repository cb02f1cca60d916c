"""Licence scan by ordered signature rules.

A text's words are joined by one space. A rule (license_rules.py) is tried only if all its keywords are
among the words, so most texts meet no pattern at all. Of all finds of a text, one that lies within the
words of another of the same or a higher priority gives way to it; of equal finds the higher priority
stays, then the earlier rule. Finds that only overlap stay both.

Each text is read whole by one task and nothing is shuffled; long texts are split into words piece by
piece, so that no list of all their words is held.

Defined cases: a null text is the empty text and has no words, no finds and score 0; rows that repeat an id
are scanned each; an empty table gives an empty result; other columns are ignored and may have any name.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import license_rules
from eventloom.llm.common import bound_batches

#: Bytes that are no word character (0-9, A-Z, a-z, any byte of a longer character) become a space; A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20
FIND = "struct<label:string,section:string,priority:int,confidence:double,rule:int,first_word:long,last_word:long,found:string,kept:boolean>"


class Scanner:
    def __init__(self):
        self.rules, self.by_key = [], {}
        for section, label, keywords, pattern in license_rules.rules():
            priority, confidence = license_rules.SECTIONS[section]
            self.add(section, label, priority, confidence, keywords, pattern)
        priority, confidence = license_rules.SECTIONS["name"]
        for phrase, label in license_rules.BASE:
            self.add("base", label, priority, confidence, frozenset(phrase.split()), phrase)
        self.keys = frozenset(k for _, _, _, _, keywords, _ in self.rules for k in keywords)

    def add(self, section, label, priority, confidence, keywords, pattern):
        keys = frozenset(k.encode() for k in keywords)
        self.rules.append((section, label, priority, confidence, keys, re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])")))
        # the longest keyword is the rarest as a rule
        self.by_key.setdefault(max(keys, key=lambda k: (len(k), k)), []).append(len(self.rules) - 1)

    def words(self, text: bytes):
        """(words joined by one space, their number, keywords among them)"""
        clean, pieces, count, met, at = text.translate(WORD_BYTES), [], 0, set(), 0
        while at < len(clean):
            end = clean.find(b" ", at + PIECE)
            end = len(clean) if end < 0 else end
            part = clean[at:end].split()
            at = end
            if part:
                count += len(part)
                met |= self.keys.intersection(part)
                pieces.append(b" ".join(part))
        return b" ".join(pieces), count, met

    def finds(self, joined: str, met):
        """[priority, rule, first word, last word, text, kept] of every match of the rules whose keywords are met."""
        out, starts = [], None
        for n in sorted(n for key in met for n in self.by_key.get(key, ()) if self.rules[n][4] <= met):
            for m in self.rules[n][5].finditer(joined):
                if starts is None:
                    starts = list(accumulate((len(w) + 1 for w in joined.split(" ")), initial=0))
                out.append([self.rules[n][2], n, bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1, m[0], True])
        return suppress(out)

    def scan(self, text: bytes | None):
        """(number of words, finds in order of their place, score)"""
        joined, count, met = self.words(text or b"")
        if not met:
            return count, [], 0.0
        found = self.finds(joined.decode(), met)
        best: dict[str, float] = {}
        for f in found:
            if f[5]:
                _, label, _, confidence, _, _ = self.rules[f[1]]
                best[label] = max(best.get(label, 0.0), confidence)
        doubt = 1.0
        for label in sorted(best):
            doubt *= 1 - best[label]
        return count, found, round(1 - doubt, 6)


def suppress(finds):
    """Finds in order of their place, the last entry False where another one of the same or a higher priority covers it."""
    finds = sorted(finds, key=lambda f: (f[2], -f[3], f[0], f[1]))
    reach: dict[int, int] = {}  # priority: furthest last word of the finds so far
    for f in finds:
        # equal places come highest priority first, so whatever reaches as far and isn't lower stays before this one
        f[5] = not any(last >= f[3] for priority, last in reach.items() if priority <= f[0])
        reach[f[0]] = max(reach.get(f[0], -1), f[3])
    return finds


def _scan_rows(batches):
    import pyarrow as pa
    import pyarrow.compute as pc
    scanner = Scanner()
    fields = ["label", "section", "priority", "confidence", "rule", "first_word", "last_word", "found", "kept"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    for batch in batches:
        texts = pc.cast(batch.column(1), pa.large_binary())
        counts, scores, bounds, flat = [], [], [0], []
        for i in range(len(texts)):
            count, found, score = scanner.scan(texts[i].as_py())
            counts.append(count)
            scores.append(score)
            for priority, n, first, last, text, kept in found:
                section, label, _, confidence, _, _ = scanner.rules[n]
                flat.append((label, section, priority, confidence, n, first, last, text, kept))
            bounds.append(len(flat))
        columns = list(zip(*flat)) if flat else [[] for _ in fields]
        finds = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), finds),
                                          pa.array(scores, pa.float64())], ["id", "n_words", "finds", "score"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row of docs: id, n_words, finds (label, section, priority, confidence, rule, first_word, last_word,
    found, kept; suppressed ones too, in order of their place), score."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_scan_rows, f"id {dict(docs.dtypes)[id_col]}, n_words long, finds array<{FIND}>, score double")
    return out.withColumnRenamed("id", id_col)


def license_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of documents."""
    base = F.filter("finds", lambda f: f["section"] == "base")
    kept = F.filter("finds", lambda f: f["kept"] | (f["section"] == "base"))
    starts = F.transform(base, lambda f: f["first_word"])

    def listed(finds):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(finds, lambda f: f["label"]))))
    return scan_licenses(docs).select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                                      F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(kept).alias("labels"), "score")
