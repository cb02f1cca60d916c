"""Faker value generators as pure Column expressions.

Each faker hashes ``(seed, key, field)`` once (MD5, 128 bits) and slices that hash
into the lanes it needs, so a faker costs one hash per row. Unknown faker names give
an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventloom.functions import draws as D

# ---- fixed values (must equal the reference's lists, in its order) -----------------
HOST_WORDS = ["web", "db", "cache", "api", "edge", "worker", "auth", "log"]
USER_NAMES = ["alice", "bob", "carol", "dave", "erin", "frank", "grace", "heidi", "ivan", "judy"]
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "curl/8.4.0",
    "python-requests/2.31.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Mobile/15E148 Safari/604.1",
]
HTTP_STATUSES = [200, 201, 204, 301, 302, 304, 400, 401, 403, 404, 429, 500, 502, 503]
URL_PATHS = ["/", "/login", "/api/v1/users", "/health", "/static/app.js", "/search?q=x"]
# ---------------------------------------------------------------------------------------

FAKERS = ("ipv4", "ipv6", "mac", "uuid", "hostname", "username", "user_agent", "url", "http_status")


def _idx(b: "D.KeyedBits", lane_no: int, n: int) -> Column:
    return F.floor(b.unit(lane_no) * F.lit(float(n)))


def ipv4(h) -> Column:
    return F.concat_ws(
        ".",
        (F.lit(1) + _idx(h, 0, 223)).cast("string"),
        _idx(h, 1, 256).cast("string"),
        _idx(h, 2, 256).cast("string"),
        (F.lit(1) + _idx(h, 3, 254)).cast("string"),
    )


def ipv6(b) -> Column:
    h = b.hex()
    groups = [F.regexp_replace(F.substring(h, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)]
    return F.concat_ws(":", *groups)


def mac(b) -> Column:
    h = b.hex()
    return F.concat_ws(":", *[F.substring(h, 1 + 2 * i, 2) for i in range(6)])


def uuid4(b) -> Column:
    h = b.hex()
    variant = F.substring(F.lit("89ab"),
                          (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12),
    )


def _host(h, a: int, b: int) -> Column:
    return F.concat(D.pick(HOST_WORDS, _idx(h, a, len(HOST_WORDS))), F.lit("-"),
                    F.lpad((F.lit(1) + _idx(h, b, 99)).cast("string"), 2, "0"))


def hostname(h) -> Column:
    return _host(h, 0, 1)


def username(h) -> Column:
    return D.pick(USER_NAMES, _idx(h, 0, len(USER_NAMES)))


def user_agent(h) -> Column:
    return D.pick(USER_AGENTS, _idx(h, 0, len(USER_AGENTS)))


def url(h) -> Column:
    return F.concat(F.lit("https://"), _host(h, 0, 1), F.lit(".example.com"),
                    D.pick(URL_PATHS, _idx(h, 2, len(URL_PATHS))))


def http_status(h) -> Column:
    return D.pick([str(s) for s in HTTP_STATUSES], _idx(h, 0, len(HTTP_STATUSES)))


_BUILDERS = {
    "ipv4": ipv4, "ipv6": ipv6, "mac": mac, "uuid": uuid4, "hostname": hostname,
    "username": username, "user_agent": user_agent, "url": url, "http_status": http_status,
}


def faker(kind: str, seed: int, key, salt: str | None = None) -> Column:
    """Value of faker ``kind`` (``ipv4``, ``uuid``…, with or without ``faker.``) for a key."""
    kind = kind[len("faker."):] if kind.startswith("faker.") else kind
    fn = _BUILDERS.get(kind)
    if fn is None:
        return F.lit("")
    return fn(D.KeyedBits(seed, key, salt or f"faker.{kind}"))


# ---------------------------------------------------------------- SQL mirrors (oracle)

def _sql_list(vals) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in vals) + "]"


def _sql_idx(h: str, lane_no: int, n: int) -> str:
    return f"CAST(floor({D.sql_lane(h, lane_no)} * {float(n)!r}) AS BIGINT)"


def sql_faker(kind: str, seed: int, key_sql: str, salt: str | None = None) -> str:
    kind = kind[len("faker."):] if kind.startswith("faker.") else kind
    h = D.sql_keyed_hex(seed, key_sql, salt or f"faker.{kind}")
    if kind == "ipv4":
        return (f"concat_ws('.', CAST(1 + {_sql_idx(h, 0, 223)} AS VARCHAR), CAST({_sql_idx(h, 1, 256)} AS VARCHAR),"
                f" CAST({_sql_idx(h, 2, 256)} AS VARCHAR), CAST(1 + {_sql_idx(h, 3, 254)} AS VARCHAR))")
    if kind == "ipv6":
        return "concat_ws(':', " + ", ".join(
            f"regexp_replace(substr({h}, {1 + 4 * i}, 4), '^0{{1,3}}', '')" for i in range(8)) + ")"
    if kind == "mac":
        return "concat_ws(':', " + ", ".join(f"substr({h}, {1 + 2 * i}, 2)" for i in range(6)) + ")"
    if kind == "uuid":
        var = f"substr('89ab', CAST(CAST(concat('0x', substr({h}, 17, 1)) AS BIGINT) % 4 + 1 AS BIGINT), 1)"
        return (f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-4', substr({h}, 14, 3), '-',"
                f" {var}, substr({h}, 18, 3), '-', substr({h}, 21, 12))")
    host = (f"concat({_sql_list(HOST_WORDS)}[{_sql_idx(h, 0, len(HOST_WORDS))} + 1], '-',"
            f" lpad(CAST(1 + {_sql_idx(h, 1, 99)} AS VARCHAR), 2, '0'))")
    if kind == "hostname":
        return host
    if kind == "username":
        return f"{_sql_list(USER_NAMES)}[{_sql_idx(h, 0, len(USER_NAMES))} + 1]"
    if kind == "user_agent":
        return f"{_sql_list(USER_AGENTS)}[{_sql_idx(h, 0, len(USER_AGENTS))} + 1]"
    if kind == "url":
        return f"concat('https://', {host}, '.example.com', {_sql_list(URL_PATHS)}[{_sql_idx(h, 2, len(URL_PATHS))} + 1])"
    if kind == "http_status":
        return f"{_sql_list([str(s) for s in HTTP_STATUSES])}[{_sql_idx(h, 0, len(HTTP_STATUSES))} + 1]"
    return "''"
