"""Generated text must match its pattern (checked with Python's Unicode-aware re)."""

import regex as re  # Unicode TR18 classes (\\w includes marks), like the generator

from pyspark.sql import functions as F

from eventloom.catalog.q_fields import REGEX_FIELDS


def test_generated_text_matches(spark, sf_small):
    import __spark_entry__ as E
    df = E.queries()["regex_text"](spark, sf_small)
    for name, pat in REGEX_FIELDS.items():
        if name == "word":
            assert df.filter(F.col(name) != "").count() == 0
            continue
        vals = [r[0] for r in df.select(name).collect()]
        bad = [v for v in vals if not re.fullmatch(pat, v, flags=re.V1)]
        assert not bad, (name, bad[:3])
    assert df.select("req").distinct().count() > 100
    levels = {r.level for r in df.select("level").distinct().collect()}
    assert levels == {"INFO", "WARN", "ERROR", "DEBUG"}


def test_deterministic(spark, sf_small):
    import __spark_entry__ as E
    a = E.queries()["regex_text"](spark, sf_small).repartition(3)
    b = E.queries()["regex_text"](spark, sf_small)
    assert sorted(a.collect()) == sorted(b.collect())


def test_class_sets_equal_the_unicode_engine():
    from eventloom.functions import regex_text as RT
    sample = [chr(c) for c in (*range(0x250), *range(0x370, 0x400), 0x4E00, 0x1F600, 0x10FFFF)]
    for mine, theirs in [(r"[\p{Lu}\d]", r"[\p{Lu}\d]"), (r"[[:alpha:]]", "[A-Za-z]"), (r"[[:^space:]&&[:ascii:]]", r"[\x00-\x08\x0e-\x1f!-\x7f]"),
                         (r"[a-z&&[^aeiou]]", r"[a-z--[aeiou]]"), (r"[\w--[\d_]--a]", r"[\w--[\d_a]]"), (r"[a-f~~d-k]", "[a-cg-k]"),
                         (r"[^\p{L}\n-]", r"[^\p{L}\n\-]"), (r"[]a]", r"[\]a]"), (r"\p{^Greek}", r"\P{Greek}"), (r"[a-c&&x]", r"(?!)")]:
        got = re.compile(RT._standard(mine), flags=re.V0)
        want = re.compile(theirs, flags=re.V1)
        assert [bool(got.fullmatch(c)) for c in sample] == [bool(want.fullmatch(c)) for c in sample], mine


def test_unknown_sets_give_empty_text(spark):
    from eventloom.functions.regex_text import regex_text
    row = spark.range(1).select(*[regex_text(p, 1, "id", "f").alias(f"c{i}") for i, p in enumerate(
        [r"\p{Nonsense}", "[[:wrong:]]", "[a", "[z-a]", r"[\q]", r"(a)\1"])]).first()
    assert set(row) == {""}


def _slow_text(pattern, key, salt):
    """One class, repeated: the text by plain Python from the same hashes."""
    import hashlib
    lo, hi, chars = pattern

    def draw(*parts):
        return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2 ** 52
    n = lo + int(draw(5, key, f"{salt}/r.0#n") * (hi - lo + 1)) if hi > lo else lo
    return "".join(chars[int(draw(5, key, j, f"{salt}/r.0*.0") * len(chars))] for j in range(1, n + 1))


def test_each_draw_stands_once(spark):
    from eventloom.functions.regex_text import regex_text
    wide = [chr(c) for c in (*range(0x21, 0x80), *range(0x400, 0xD800), *range(0xE000, 0x10000), *range(0x1F600, 0x1F700))]
    cases = {"[a-f]{0,5}": (0, 5, "abcdef"), "[x-z]{3}": (3, 3, "xyz"), "[0-9]{2,40}": (2, 18, "0123456789"),
             r"[\x{21}-\x{7F}\x{400}-\x{FFFF}\x{1F600}-\x{1F6FF}]{1,4}": (1, 4, wide)}
    df = spark.range(200).select("id", *[regex_text(p, 5, "id", "f").alias(f"c{i}") for i, p in enumerate(cases)],
                                 regex_text("(ab|c|[0-9])", 5, "id", "f").alias("branch"))
    for row in df.collect():
        assert [row[f"c{i}"] for i in range(len(cases))] == [_slow_text(p, row["id"], "f") for p in cases.values()]
    # draws by field: a count and a character for the first, a character for the second, ...; one for the branch and one for its digit
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 2 + 1 + 2 + 2 + 2


def test_few_row_groups_feed_all_cores(spark, sf_small):
    import __spark_entry__ as E
    tasks = E.queries()["regex_text"](spark, sf_small).rdd.glom().map(len).collect()
    assert len(tasks) >= 4 and min(tasks) > 0
