"""Random text matching a regular expression, compiled once on the driver into Columns.

Rules: literals are copied; a class picks a code point uniformly over its ranges
(``.`` is every scalar value but LF, ``\\d \\w \\s`` are the Unicode sets); an
alternation picks a branch uniformly; a repeat picks its count uniformly in
``[min, max]`` with open maxima capped at ``min + 16``; anchors and look-arounds emit
nothing; a pattern that does not parse (or uses back-references) gives ``''``.

Classes have a grammar of their own: ``\\p{Lu}``, ``\\PL``, ``[[:alpha:]]``, ``[[:^digit:]]``, nested classes and
the set operators ``&&``, ``--``, ``~~`` (equal rank, from left to right, weaker than listing). Each class becomes
its code-point ranges before the rest of the pattern is parsed; ``(?<name>…)``, ``\\x{…}`` and ``\\z`` work, too.

Each choice is a keyed draw salted with the node's path and the repeat iteration, so the
text depends only on (seed, key, field). Every draw stands once in the expression and is made
once for each use of its node; a repeat is a ``transform`` over its iterations.
"""

from __future__ import annotations

import bisect
import functools
import re

from pyspark.sql import Column, functions as F

from eventloom.functions import draws as D

try:  # the standard library's regex parser (``sre_parse``)
    from re import _constants as _C, _parser as _P
except ImportError:  # pragma: no cover - older Pythons
    import sre_constants as _C  # type: ignore
    import sre_parse as _P  # type: ignore

# ---- fixed values ---------------------------------------------------------------------------
MAX_REPEAT_EXTRA = 16
MAX_CODE_POINT = 0x10FFFF
SURROGATES = (0xD800, 0xDFFF)
SMALL_CLASS = 4096
# ---------------------------------------------------------------------------------------------


class Unsupported(ValueError):
    pass


def _merge(ranges):
    rs = sorted((lo, hi) for lo, hi in ranges if lo <= hi)
    out = []
    for lo, hi in rs:
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _minus_surrogates(ranges):
    out = []
    for lo, hi in ranges:
        if hi < SURROGATES[0] or lo > SURROGATES[1]:
            out.append((lo, hi))
            continue
        if lo < SURROGATES[0]:
            out.append((lo, SURROGATES[0] - 1))
        if hi > SURROGATES[1]:
            out.append((SURROGATES[1] + 1, hi))
    return out


def _complement(ranges):
    out, prev = [], 0
    for lo, hi in _merge(ranges):
        if lo > prev:
            out.append((prev, lo - 1))
        prev = hi + 1
    if prev <= MAX_CODE_POINT:
        out.append((prev, MAX_CODE_POINT))
    return out


@functools.lru_cache(maxsize=None)
def _matching(pattern: str):
    """Code-point ranges of the characters that match a Unicode set (``\\d``, ``\\p{Greek}``), built once per process."""
    import regex
    low, high = (range(SURROGATES[0]), range(SURROGATES[1] + 1, MAX_CODE_POINT + 1))
    try:
        wanted = regex.compile(f"(?:{pattern})+", flags=regex.V1)
    except regex.error as wrong:
        raise Unsupported(pattern) from wrong
    return tuple((part.start + m.start(), part.start + m.end() - 1)
                 for part in (low, high) for m in wanted.finditer("".join(map(chr, part))))


def _category_ranges(cat: str):
    """Unicode digit / word / space sets (Unicode TR18 definitions, as the ``regex`` module implements them)."""
    return _matching({"digit": r"\d", "word": r"\w", "space": r"\s"}[cat])


# ---- fixed values: POSIX classes (ASCII) and the escapes of single characters ------------------------
POSIX = {
    "alnum": ((48, 57), (65, 90), (97, 122)), "alpha": ((65, 90), (97, 122)), "ascii": ((0, 127),), "blank": ((9, 9), (32, 32)),
    "cntrl": ((0, 31), (127, 127)), "digit": ((48, 57),), "graph": ((33, 126),), "lower": ((97, 122),), "print": ((32, 126),),
    "punct": ((33, 47), (58, 64), (91, 96), (123, 126)), "space": ((9, 13), (32, 32)), "upper": ((65, 90),),
    "word": ((48, 57), (65, 90), (95, 95), (97, 122)), "xdigit": ((48, 57), (65, 70), (97, 102)),
}
CONTROLS = {"n": 10, "t": 9, "r": 13, "f": 12, "v": 11, "a": 7, "0": 0}
# ----------------------------------------------------------------------------------------------------------
_HEX = re.compile(r"\\(?:[xuU]\{([0-9A-Fa-f]{1,8})\}|x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8}))")
_PROPERTY = re.compile(r"\\([pP])(?:\{(\^?)([^{}]+)\}|([A-Z]))")
_POSIX_NAME = re.compile(r"\[:(\^?)([a-z]+):\]")


def _escape(text: str, i: int):
    """The set that the escape at ``i`` stands for, and the place after it; None for escapes of other kinds."""
    if hit := _HEX.match(text, i):
        point = int(next(g for g in hit.groups() if g), 16)
        if point > MAX_CODE_POINT:
            raise Unsupported(hit.group())
        return [(point, point)], hit.end()
    if hit := _PROPERTY.match(text, i):
        found = list(_matching(f"\\p{{{hit.group(3) or hit.group(4)}}}"))
        return (_complement(found) if (hit.group(1) == "P") != bool(hit.group(2)) else found), hit.end()
    kind = text[i + 1:i + 2]
    if kind and kind in "dDwWsS":
        found = list(_matching("\\" + kind.lower()))
        return (found if kind.islower() else _complement(found)), i + 2
    return None


def _joined(left, op: str, right):
    """left op right as sets of ranges."""
    if op == "":
        return right
    both = _complement(_complement(left) + _complement(right))
    if op == "&&":
        return both
    if op == "--":
        return _complement(_complement(left) + _merge(right))
    return _complement(_complement(left + right) + both)


def _class_at(text: str, i: int):
    """The set of the class that opens at ``i``, and the place after its bracket."""
    negated = text.startswith("^", i + 1)
    i += 2 if negated else 1
    left, op, listed, first = [], "", [], True
    while True:
        if i >= len(text):
            raise Unsupported("open class")
        if text[i] == "]" and not first:
            found = _joined(left, op, _merge(listed))
            return (_complement(found) if negated else _merge(found)), i + 1
        if text[i:i + 2] in ("&&", "--", "~~"):
            left, op, listed, i = _joined(left, op, _merge(listed)), text[i:i + 2], [], i + 2
        elif named := _POSIX_NAME.match(text, i):
            if named.group(2) not in POSIX:
                raise Unsupported(named.group())
            found = list(POSIX[named.group(2)])
            listed, i = listed + (_complement(found) if named.group(1) else found), named.end()
        elif text[i] == "[":
            found, i = _class_at(text, i)
            listed = listed + found
        else:
            found, i = _member(text, i)
            if len(found) == 1 and found[0][0] == found[0][1] and text[i:i + 1] == "-" and text[i + 1:i + 2] not in ("]", "-", ""):
                end, i = _member(text, i + 1)
                if len(end) != 1 or end[0][0] != end[0][1] or end[0][0] < found[0][0]:
                    raise Unsupported("range")
                found = [(found[0][0], end[0][0])]
            listed = listed + found
        first = False


def _member(text: str, i: int):
    if text[i] != "\\":
        return [(ord(text[i]), ord(text[i]))], i + 1
    if found := _escape(text, i):
        return found
    kind = text[i + 1:i + 2]
    if kind in CONTROLS:
        return [(CONTROLS[kind], CONTROLS[kind])], i + 2
    if not kind or kind.isalnum():
        raise Unsupported(f"escape {kind}")
    return [(ord(kind), ord(kind))], i + 2


def _spelled(ranges) -> str:
    """A class of the standard syntax for the ranges (none at all: the class without members)."""
    listed = "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in _merge(ranges))
    return f"[{listed}]" if listed else f"[^\\U00000000-\\U{MAX_CODE_POINT:08x}]"


def _standard(pattern: str) -> str:
    """The pattern with its classes, properties and code points spelled in the standard parser's syntax."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "[":
            found, i = _class_at(pattern, i)
            out.append(_spelled(found))
        elif pattern[i] == "\\":
            hit = _escape(pattern, i)
            if hit and pattern[i + 1] in "pPxuU":
                out.append(_spelled(hit[0]) if pattern[i + 1] in "pP" else re.escape(chr(hit[0][0][0])))
                i = hit[1]
            else:
                out.append("\\Z" if pattern[i:i + 2] == "\\z" else pattern[i:i + 2])
                i += 2
        else:
            named = pattern.startswith("(?<", i) and pattern[i + 3:i + 4] not in ("=", "!", "")
            out.append("(?P<" if named else pattern[i])
            i += 3 if named else 1
    return "".join(out)


_CATS = {
    "CATEGORY_DIGIT": ("digit", False), "CATEGORY_NOT_DIGIT": ("digit", True),
    "CATEGORY_WORD": ("word", False), "CATEGORY_NOT_WORD": ("word", True),
    "CATEGORY_SPACE": ("space", False), "CATEGORY_NOT_SPACE": ("space", True),
}


def _class_ranges(items):
    neg = False
    rs = []
    for op, av in items:
        name = str(op)
        if name == "NEGATE":
            neg = True
        elif name == "LITERAL":
            rs.append((av, av))
        elif name == "RANGE":
            rs.append(av)
        elif name == "CATEGORY":
            cat, inv = _CATS.get(str(av), (None, False))
            if cat is None:
                raise Unsupported(str(av))
            r = list(_category_ranges(cat))
            rs.extend(_complement(r) if inv else r)
        else:
            raise Unsupported(name)
    rs = _merge(rs)
    if neg:
        rs = _complement(rs)
    return _minus_surrogates(_merge(rs))


def codepoint_char(cp: Column) -> Column:
    """One character from a code point: its UTF-8 bytes as one number, written in hex once."""
    cp = cp.cast("bigint")

    def tail(bits: int, at: int) -> Column:  # a continuation byte
        return F.shiftleft(F.shiftright(cp, bits).bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)), at)

    def lead(bits: int, mark: int) -> Column:
        return F.shiftleft(F.shiftright(cp, bits).bitwiseOR(F.lit(mark).cast("bigint")), 4 * bits // 3)
    number = (F.when(cp < 0x80, cp)
              .when(cp < 0x800, lead(6, 0xC0) + tail(0, 0))
              .when(cp < 0x10000, lead(12, 0xE0) + tail(6, 8) + tail(0, 0))
              .otherwise(lead(18, 0xF0) + tail(12, 16) + tail(6, 8) + tail(0, 0)))
    return F.unhex(F.hex(number)).cast("string")


def _bind(x: Column, f) -> Column:
    """Evaluate ``x`` once and use it (possibly many times) inside ``f``."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _tree(pick: Column, cum, ranges, lo, hi) -> Column:
    """The code point at ``pick`` among the ranges; each cut halves the characters, so that wide ranges lie near the root."""
    before = cum[lo] - (ranges[lo][1] - ranges[lo][0] + 1)
    if hi - lo == 1:
        return pick + (ranges[lo][0] - before)
    mid = min(max(bisect.bisect_left(cum, (before + cum[hi - 1]) / 2, lo, hi), lo + 1), hi - 1)
    return F.when(pick < cum[mid - 1], _tree(pick, cum, ranges, lo, mid)).otherwise(_tree(pick, cum, ranges, mid, hi))


class _Compiler:
    def __init__(self, seed, keys, name):
        self.seed, self.keys, self.name, self.prefix = seed, keys, name, None

    def text(self, tree) -> Column:
        items = list(tree)
        if _literal(items) is not None or D.current_mode() == "fast":
            return self.seq(items, "r", [])

        def with_prefix(prefix):
            self.prefix = prefix
            return self.seq(items, "r", [])
        return _bind(D.key_prefix(self.seed, self.keys), with_prefix)

    def u(self, path: str, idx) -> Column:
        if self.prefix is None:
            return D.draw(self.seed, self.keys + list(idx), f"{self.name}/{path}")
        return D.draw_after(self.prefix, idx, f"{self.name}/{path}")

    def klass(self, ranges, path, idx) -> Column:
        if not ranges:
            return F.lit("")
        total = sum(hi - lo + 1 for lo, hi in ranges)
        if total == 1:
            return F.lit(chr(ranges[0][0]))
        pick = F.floor(self.u(path, idx) * F.lit(float(total))).cast("int")
        pick = F.least(pick, F.lit(total - 1))
        if total <= SMALL_CLASS:
            chars = "".join(chr(c) for lo, hi in ranges for c in range(lo, hi + 1))
            return F.element_at(F.split(F.lit(chars), ""), pick + 1)  # the split is folded to one literal
        cum, acc = [], 0
        for lo, hi in ranges:
            acc += hi - lo + 1
            cum.append(acc)
        # bind the draw once (lambda variable) so the search tree does not copy it per node
        return _bind(pick, lambda p: _bind(_tree(p, cum, ranges, 0, len(ranges)), codepoint_char))

    def seq(self, items, path, idx) -> Column:
        parts = [self.item(op, av, f"{path}.{i}", idx) for i, (op, av) in enumerate(items)]
        parts = [p for p in parts if p is not None]
        if not parts:
            return F.lit("")
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def item(self, op, av, path, idx):
        name = str(op)
        if name == "LITERAL":
            return F.lit(chr(av))
        if name == "NOT_LITERAL":
            return self.klass(_minus_surrogates(_complement([(av, av)])), path, idx)
        if name == "ANY":
            return self.klass(_minus_surrogates([(0, 9), (11, MAX_CODE_POINT)]), path, idx)
        if name == "IN":
            return self.klass(_class_ranges(av), path, idx)
        if name in ("AT", "ASSERT", "ASSERT_NOT"):
            return None
        if name == "SUBPATTERN":
            return self.seq(av[-1], path, idx)
        if name == "ATOMIC_GROUP":
            return self.seq(av, path, idx)
        if name == "BRANCH":
            branches = av[1]
            n = len(branches)
            k = F.least(F.floor(self.u(path, idx) * F.lit(float(n))).cast("int"), F.lit(n - 1))
            texts = [_literal(b) for b in branches]
            if None not in texts:
                return F.element_at(F.array(*[F.lit(x) for x in texts]), k + 1)

            def chosen(k):
                expr = F
                for i, b in enumerate(branches[:-1]):
                    expr = expr.when(k == i, self.seq(b, f"{path}|{i}", idx))
                return expr.otherwise(self.seq(branches[-1], f"{path}|{n - 1}", idx))
            return _bind(k, chosen)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            lo, hi, sub = av
            cap = lo + MAX_REPEAT_EXTRA
            hi = cap if hi == _C.MAXREPEAT else min(hi, cap)
            count = (F.lit(lo) + F.floor(self.u(path + "#n", idx) * F.lit(float(hi - lo + 1))).cast("int")
                     if hi > lo else F.lit(lo))
            count = F.least(count, F.lit(hi))
            if not hi:
                return F.lit("")
            if (text := _literal(sub)) is not None:
                return F.repeat(F.lit(text), count)
            if hi == 1:
                once = self.seq(sub, path + "*", idx + [F.lit(1)])
                return once if lo else F.when(count > 0, once).otherwise(F.lit(""))
            # exact draws hash the round as text; both forms are folded to one literal
            rounds = F.sequence(F.lit(1), F.lit(hi)) if self.prefix is None else F.split(F.lit(" ".join(map(str, range(1, hi + 1)))), " ")
            return F.array_join(F.transform(F.slice(rounds, F.lit(1), count) if hi > lo else rounds,
                                            lambda j: self.seq(sub, path + "*", idx + [j])), "")
        raise Unsupported(name)


def _literal(items) -> str | None:
    """The text of a sub-pattern of literals only, else None."""
    return "".join(chr(av) for _, av in items) if all(str(op) == "LITERAL" for op, _ in items) else None


def regex_text(pattern: str, seed: int, key, name: str) -> Column:
    """Text matching ``pattern`` for each row (``''`` for an unsupported/bad pattern)."""
    try:
        tree = _P.parse(_standard(pattern))
        return _Compiler(seed, D._keys(key), name).text(tree)
    except (re.error, Unsupported, OverflowError):
        return F.lit("")
