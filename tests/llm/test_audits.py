"""Divergence audit, Merkle manifest and licence scan against plain versions, with odd rows of every kind."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from eventloom.llm import level_products, license_rules, license_scan, merkle_manifest, queries

SF = "/root/testdata/sf0.001"
#: The operators' own column names beside those of documents.
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, tree string, hash string, rank long, n long, "
        "term string, finds string, id long, total long, `group` string")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = ("x", "y", 1, 2, "z", None, 3, 4, "g")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS).repartition(3)


def odd_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "Straße", "don't", "été", "x1y", "中文", "delta"]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 10), k=rng.randint(0, 40))), rng.choice(["en", "de", "", None]),
             rng.choice(["s1", "s1", "s2", "", None, "=s1"]), i) for i in range(120)]
    rows += [(200, None, "fr", "s1", None), (201, "", "fr", "s2", 0), (None, "no ID", "en", "s1", 5), (None, "no ID", "en", "s1", 5),
             (7, "Other text", rows[7][2], "s9", None), rows[9], rows[9], (300, "Alpha beta " * 20000, "en", "s2", None),
             (301, "All Rights Reserved.\tall rights-reserved", None, None, None), (302, "\x00\x1f ~~ \x7f", "en", "only", 3)]
    return rows


# --- divergence audit

def plain_divergence(rows):
    docs = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(UPPER))) for r in rows]
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= 10]
        groups = sorted({s for l, s, _ in docs if l == lang})
        whole = Counter()
        for s in groups:
            whole.update(counts[lang, s])

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        p, q = {s: shares(counts[lang, s]) for s in groups}, shares(whole)
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t])), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def test_divergence_of_odd_rows(spark):
    rows = odd_rows()
    got = sorted(map(tuple, level_products.divergence(frame(spark, rows)).collect()))
    want = plain_divergence(rows)
    assert got == want
    assert {"pair", "term"} == {r[2] for r in got} and any(r[0] == "fr" and r[4] == 0 for r in got)


def test_divergence_of_an_empty_table(spark):
    assert level_products.divergence(spark.createDataFrame([], DOCS)).collect() == []


def test_divergence_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(level_products.DIVERGENCE_SQL).fetchall())
    assert sorted(map(tuple, queries.op11_level_products(spark, SF).collect())) == want and want


@pytest.mark.parametrize("columns", [2, 7, 1024])
def test_products_in_blocks_of_columns(columns):
    rng = np.random.default_rng(3)
    x = (rng.random((50, 23)) < 0.2).astype(int)
    got = np.zeros((23, 23), int)
    for i, j, n in level_products.multiply([np.flatnonzero(r) for r in x], columns):
        assert (i <= j).all()
        got[i, j] += n
    assert (got == np.triu(x.T @ x)).all()


def test_joint_tables_do_not_depend_on_blocks(spark):
    docs = frame(spark, odd_rows()).fillna("")
    from pyspark.sql import functions as F
    terms = (level_products.term_counts(docs).groupBy("lang", "term")
             .agg(F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("groups"))).cache()
    large, small = (sorted(map(tuple, level_products.joint_tables(terms, t, c).collect())) for t, c in ((4096, 1024), (3, 2)))
    assert large == small
    whole = {(r[0], r[1], r[2]): r[5] for r in large if r[1] == r[3]}
    levels = Counter((r.lang, "=" + g.source, g.n) for r in terms.collect() for g in r.groups)
    assert all(whole[k] == n for k, n in levels.items())


# --- Merkle manifest

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def rolled(hashes):
    """Root and each leaf's (left, right) siblings."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, a in enumerate(at):
            run = a // 8 * 8
            paths[i].append(("".join(hashes[run:a]), "".join(hashes[a + 1:run + 8])))
            at[i] = a // 8
        hashes = [sha("".join(hashes[i:i + 8])) for i in range(0, len(hashes), 8)]
    return hashes[0], paths


def plain_audit(rows):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        head = "".join(map(field, (doc_id, source, lang, n_chars)))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees[lang].append((doc_id, sha(head + field(text)), sha(head + field(text and text.translate(UPPER))) if hit else None))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in trees.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    low = {k: rolled([r[1] for r in trees[k]]) for k in names}
    root, tops = rolled([low[k][0] for k in names])
    out = []
    for k, top in zip(names, tops):
        for (doc_id, leaf, changed), path in zip(trees[k], low[k][1]):
            h = changed or leaf
            for l, r in path + top:
                h = sha(l + h + r)
            out.append((doc_id, leaf, low[k][0], root, sha("".join(l + r for l, r in path + top)), h, h == root))
    return sorted(out, key=repr)


def many_trees():
    """Two levels of blocks in one tree, runs of one node, more than eight trees."""
    rows = [(i * 3, f"Text {i}" if i % 2 else f"text {i}", "long", "s", i) for i in range(1025)]
    return rows + [(i, "A b", f"lang{i % 11}", None, None) for i in range(40)] + [(5000, "lone", "ü", "s", 1)]


@pytest.mark.parametrize("rows", [odd_rows(), many_trees(), odd_rows()[:1]], ids=["odd", "many", "one"])
def test_manifest_against_plain_version(spark, rows):
    got = sorted(map(tuple, merkle_manifest.audit(frame(spark, rows)).collect()), key=repr)
    assert got == plain_audit(rows)


def test_manifest_of_an_empty_table(spark):
    assert merkle_manifest.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_tampering_is_found_where_a_text_has_capitals(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    for r in queries.op12_merkle_manifest(spark, SF).collect():
        hit = zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        assert r.verified == (not hit or texts[r.doc_id] is None or texts[r.doc_id] == texts[r.doc_id].translate(UPPER))


# --- licence scan

def plain_scan(text):
    """Every rule whose keywords occur, every pair of finds compared."""
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    joined = " ".join(words)
    rules = [(s, *license_rules.SECTIONS[s], label, keys, p) for s, label, keys, p in license_rules.rules()]
    rules += [("base", *license_rules.SECTIONS["name"], label, set(phrase.split()), phrase) for phrase, label in license_rules.BASE]
    finds = []
    for n, (section, priority, _, label, keys, pattern) in enumerate(rules):
        if keys <= set(words):
            for m in re.finditer(f"(?<![^ ])(?:{pattern})(?![^ ])", joined):
                first = joined[:m.start()].count(" ")
                finds.append((priority, n, first, first + m[0].count(" "), label, section))
    def loses(a, b):
        covered = b[2] <= a[2] and a[3] <= b[3] and b[0] <= a[0]
        return covered and ((b[2], b[3]) != (a[2], a[3]) or b[0] < a[0] or b[1] < a[1])
    kept = [a for a in finds if not any(loses(a, b) for b in finds)]
    base = [f for f in finds if f[5] == "base"]
    starts = [f[2] for f in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({f[4] for f in base})),
            ",".join(sorted({f[4] for f in kept + base})))


NOTICES = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "This work is licensed under the GNU General Public License, version 3 or later.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    "CC BY-NC 4.0, see https://creativecommons.org/licenses/by-nc/4.0/", "cc-by cc by; CC\nBY. all rights reserved? All rights\treserved!",
    "© 2020 the authors. Alle Rechte vorbehalten. Released under the MIT license.", "general public license general public licence",
    "MIT School: licensed teachers read Apache stories", "all rights are reserved", "Creative Commons Attribution-ShareAlike 3.0 Unported", None, "", " .,- ",
    "dedicated to the public domain " * 3000 + "cc by", "x" * 3_000_000 + " GPLv2 or later", "ALLÉ rights reserved", "all rights reserved",
]


def test_scan_of_notices(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(NOTICES)] + [(0, NOTICES[0], "en", None, None), (None, NOTICES[1], None, None, None)]
    got = license_scan.license_digest(frame(spark, rows)).collect()
    want = Counter((r[0], *plain_scan(r[1])) for r in rows)
    assert Counter(tuple(r)[:-1] for r in got) == want
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in got)
    by_id = {r.doc_id: r for r in got}
    assert "gpl-3.0-or-later" in by_id[1].labels and "cc-by-nc-4.0" in by_id[3].labels and by_id[7].labels == "" and by_id[6].n_base == 1
    assert by_id[4].n_base == 5 and by_id[16].n_base == 0


def test_scan_of_the_table_against_plain_version(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    got = {r.doc_id: tuple(r)[1:-1] for r in queries.op13_license_rules(spark, SF).collect()}
    assert got == {i: plain_scan(t) for i, t in texts.items()}


def test_scan_of_an_empty_table(spark):
    assert license_scan.license_digest(spark.createDataFrame([], DOCS)).collect() == []


def test_rules_are_hundreds_and_each_has_a_keyword():
    rules = license_rules.rules()
    assert len(rules) > 300 and all(keys and label for _, label, keys, _ in rules)
    assert len({(label, pattern) for _, label, _, pattern in rules}) == len(rules)


def test_containment_and_priority():
    finds = license_scan.suppress([[2, 1, 0, 5, "a", True], [4, 2, 1, 3, "b", True], [1, 3, 4, 4, "c", True], [2, 4, 0, 5, "d", True],
                                   [4, 5, 5, 8, "e", True], [5, 6, 6, 7, "f", True]])
    assert {f[4] for f in finds if f[5]} == {"a", "c", "e"}
