"""Message templates: ``{{name}}`` placeholders compiled on the driver into ``concat``.

Rules: a closed ``{{name}}`` with a known value is replaced by it (NULL → empty);
an unknown name stays as the literal ``{{name}}``; an unclosed ``{{`` stays text;
``{{}}`` stays as is. ``faker.*`` names are generated on demand.
"""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, functions as F

from eventloom.functions import draws as D
from eventloom.functions import fakers as FK
from eventloom.functions import fields as FL

# ---- fixed values ---------------------------------------------------------------------
FALLBACK_TEMPLATE = "{{timestamp}} {{real_app}} seq={{sequence}}"
DEFAULT_HOSTNAME = "localhost"
DEFAULT_COMMAND = "echo ok"
PID_MIN, PID_MAX = 1, 65535
# ----------------------------------------------------------------------------------------

_PH = re.compile(r"\{\{(.*?)\}\}", re.S)


def parse_template(text: str) -> list[tuple[str, str]]:
    """Split into ``("lit", text)`` and ``("ph", name)`` parts."""
    parts: list[tuple[str, str]] = []
    pos = 0
    for m in _PH.finditer(text):
        if m.start() > pos:
            parts.append(("lit", text[pos:m.start()]))
        # an empty name is no placeholder: the braces stay
        parts.append(("ph", m.group(1)) if m.group(1) else ("lit", m.group(0)))
        pos = m.end()
    if pos < len(text):
        parts.append(("lit", text[pos:]))
    return parts


def placeholders(text: str) -> list[str]:
    """Distinct placeholder names in first-seen order."""
    seen: list[str] = []
    for kind, v in parse_template(text):
        if kind == "ph" and v not in seen:
            seen.append(v)
    return seen


def render_template(text: str, values: Mapping[str, Column], seed: int | None = None, key=None) -> Column:
    pieces: list[Column] = []
    for kind, v in parse_template(text):
        if kind == "lit":
            pieces.append(F.lit(v))
        elif v in values:
            pieces.append(F.coalesce(values[v].cast("string"), F.lit("")))
        elif v.startswith("faker.") and seed is not None and v[6:] in FK.FAKERS:
            pieces.append(FK.faker(v, seed, key))
        else:
            pieces.append(F.lit("{{" + v + "}}"))
    if not pieces:
        return F.lit("")
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0]


def default_values(seed: int, key, seq: Column, ts: Column, app: str | Column) -> dict[str, Column]:
    """Values every message has: sequence, timestamp, pid, hostname, real_* and app_name."""
    app_c = app if isinstance(app, Column) else F.lit(app)
    return {
        "sequence": seq.cast("string"),
        "timestamp": F.date_format(ts, FL.DATETIME_TEXT),
        "pid": D.int_from_unit(D.draw(seed, key, "pid"), PID_MIN, PID_MAX).cast("string"),
        "hostname": F.lit(DEFAULT_HOSTNAME),
        "real_hostname": F.lit(DEFAULT_HOSTNAME),
        "real_command": F.lit(DEFAULT_COMMAND),
        "real_app": app_c,
        "app_name": app_c,
    }


def pick_template(templates: Sequence[str], weights, seed: int, key, values: Mapping[str, Column]) -> Column:
    """Render one of ``templates`` per message (weighted if weights fit, else uniform)."""
    tpls = list(templates) or [FALLBACK_TEMPLATE]
    if len(tpls) == 1:
        return render_template(tpls[0], values, seed, key)
    dist = "weighted" if weights is not None and len(weights) == len(tpls) else "uniform"
    idx = FL.enum_index(seed, key, "template", len(tpls), dist, weights)
    expr = None
    for i, t in enumerate(tpls):
        r = render_template(t, values, seed, key)
        expr = F.when(idx == i, r) if expr is None else expr.when(idx == i, r)
    return expr.otherwise(render_template(tpls[-1], values, seed, key))


def pad_to_bytes(body: Column, target: int | None, seed: int, key) -> Column:
    """If shorter than ``target`` bytes: one space, then [a-z0-9] up to exactly ``target`` bytes."""
    if not target or int(target) <= 0:
        return body
    n = int(target)
    blen = F.octet_length(body)
    fill = FL.keyed_base36(seed, key, "pad", F.lit(n - 1) - blen)
    return F.when(blen < n, F.concat(body, F.lit(" "), fill)).otherwise(body)


# ---------------------------------------------------------------- SQL mirrors (oracle)

def sql_render_template(text: str, values: Mapping[str, str], seed: int | None = None, key_sql: str | None = None) -> str:
    pieces = []
    for kind, v in parse_template(text):
        if kind == "lit":
            pieces.append("'" + v.replace("'", "''") + "'")
        elif v in values:
            pieces.append(f"coalesce(CAST({values[v]} AS VARCHAR), '')")
        elif v.startswith("faker.") and seed is not None and v[6:] in FK.FAKERS:
            pieces.append(FK.sql_faker(v, seed, key_sql))
        else:
            pieces.append("'{{" + v.replace("'", "''") + "}}'")
    return "(" + " || ".join(pieces or ["''"]) + ")"


def sql_pad_to_bytes(body_sql: str, target: int, seed: int, key_sql: str) -> str:
    n = int(target)
    fill = FL.sql_keyed_base36(seed, key_sql, "pad", f"({n - 1} - strlen({body_sql}))")
    return f"(CASE WHEN strlen({body_sql}) < {n} THEN {body_sql} || ' ' || {fill} ELSE {body_sql} END)"


def placeholder_names(template: Column) -> Column:
    """Distinct placeholder names of a template column (templates stored in a table)."""
    names = F.regexp_extract_all(template, F.lit(r"(?s)\{\{(.*?)\}\}"), 1)
    return F.filter(F.array_distinct(names), lambda n: n != "")


#: A template's next token: text up to a closed placeholder or the end, then the placeholder (or nothing).
_TOKEN = r"(?s)(.*?)(\{\{.*?\}\}|\z)"


def render_template_column(template: Column, values: Mapping[str, Column]) -> Column:
    """Render a template that differs per row (a template column or a joined template table).

    The template is cut into tokens once; each token is its text and the value of its placeholder (NULL →
    empty; unknown names and ``{{}}`` stay as written). Values go in as they are: a value that looks
    like a placeholder is not expanded.
    """
    texts, marks = (F.regexp_extract_all(template, F.lit(_TOKEN), F.lit(k)) for k in (1, 2))
    known = F.map_from_arrays(F.array(*[F.lit("{{" + n + "}}") for n in values]),
                              F.array(*[F.coalesce(values[n].cast("string"), F.lit("")) for n in values])) if values else None

    def token(text, mark):
        return F.concat(text, F.coalesce(F.try_element_at(known, mark), mark) if values else mark)
    return F.when(template.isNotNull(), F.array_join(F.zip_with(texts, marks, token), ""))


def sql_render_template_column(template_sql: str, values: Mapping[str, str]) -> str:
    texts, marks = (f"regexp_extract_all({template_sql}, '{_TOKEN}', {k})" for k in (1, 2))
    cases = " ".join(f"WHEN '{{{{{n}}}}}' THEN coalesce(CAST({v} AS VARCHAR), '')" for n, v in values.items())
    value = f"CASE t[2] {cases} ELSE t[2] END" if values else "t[2]"
    return f"array_to_string(list_transform(list_zip({texts}, {marks}), lambda t: t[1] || {value}), '')"
