"""Secret scans with multipart credential linking, in Spark expressions only.

Three kinds of span are reported wherever they stand: assignments of a secret
(``assign``), access key identifiers (``access``) and long hexadecimal runs
(``hex``).  Weaker candidates mean nothing alone: account or client identifiers
(``weak_id``), mixed high-entropy runs (``weak_secret``; in NAME=value the name and
the value are runs of their own, and the name is none) and service addresses
(``endpoint``).  They are interval-joined within a scope, a distance in
characters between their spans, and reported only where complementary parts
co-occur:

* a weak secret near an identifier (``access`` or ``weak_id``);
* a weak identifier near a secret (``assign``, ``hex`` or ``weak_secret``);
* an endpoint near both an identifier and a secret.

Offsets come from the pieces between matches: Spark has no function for match
positions, but the lengths of ``split`` pieces and of the matches add up to
them.  Every text is handled in its own row, so nothing is shuffled, and the
costly expressions run only for texts that a plain test of the same pattern
lets through.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns and least lengths (of group 2, of the match, of the match).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

WEAK_ID = r"""(?i)(?:\b|_)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
WEAK_SECRET = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: The comparison SQL has the rules of before NAME=value pairs: no underscore before an identifier's name, '=' as part of a run.
SQL_WEAK_ID = WEAK_ID.replace(r"(?:\b|_)", r"\b")
SQL_WEAK_SECRET, SQL_WEAK_SECRET_FORM = r"[A-Za-z0-9+/_=-]{20,}", r"^[A-Za-z0-9+/_-]{20,}={0,2}$"
ENDPOINT = r"""\b(https?|s3|ftp|postgres(ql)?|mysql|redis|amqp|mongodb)://[^\s"'<>]{4,}"""
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
#: Characters between parts of one credential, at most.
SCOPE = 200


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)")


def _spans(text: Column, pattern: str, worth: Column) -> Column:
    """Non-overlapping leftmost matches of ``pattern``, where ``worth`` holds."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("found")))).alias("out"),
    )
    return F.when(worth, F.aggregate(both, F.struct(F.lit(0).alias("at"), _none().alias("out")), step, lambda acc: acc["out"])).otherwise(_none())


def _near(a: Column, b: Column) -> Column:
    return (a["start"] <= b["end"] + SCOPE) & (b["start"] <= a["end"] + SCOPE)


def _apart(spans: Column, *others: str) -> Column:
    """Spans that overlap none of those in the other columns."""
    def clear(other: str):
        return lambda s: ~F.exists(other, lambda x: (s["start"] < x["end"]) & (x["start"] < s["end"]))

    for other in others:
        spans = F.filter(spans, clear(other))
    return spans


def _tagged(column: str, kind: int) -> Column:
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (start, kind, end) by start, kind and end.

    kind is an index into ``KINDS``; base_spans holds the first three kinds,
    spans also the linked weak candidates.  Null texts read as empty and have
    neither.  Spans that start together are listed by kind and then end; spans of
    several kinds may overlap.  Whole texts are scanned, however long; a text's
    linking takes time in proportion to the product of its parts, so thousands of
    them in one text are slow.  Other columns stay, except that columns
    named ``base_spans`` or ``spans`` are replaced.  Repeated rows and empty
    tables give what each row alone gives.
    """
    names = {k: f"__scan_{k}" for k in ("text", *KINDS, "ids", "secrets")}
    c = {k: F.col(v) for k, v in names.items()}
    kept = [x for x in docs.columns if x not in ("base_spans", "spans")]
    t = c["text"]
    found = docs.select(*[docs[x] for x in kept]).withColumn(names["text"], F.coalesce(F.col(text_col), F.lit("")))
    assigned = F.filter(_spans(t, ASSIGN, t.rlike(ASSIGN)), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    found = found.withColumns({
        names["assign"]: assigned,
        names["access"]: F.filter(_spans(t, ACCESS, t.contains("AKIA")), lambda s: F.length(s["found"]) >= ACCESS_LEAST),
        names["hex"]: _spans(t, HEX[:-1] + f"{{{HEX_LEAST},}}", t.rlike(HEX[:-1] + f"{{{HEX_LEAST}}}")),
        names["weak_id"]: _spans(t, WEAK_ID, t.rlike(WEAK_ID)),
    })
    found = found.withColumn(names["weak_id"], _apart(c["weak_id"], names["assign"], names["access"], names["hex"]))
    found = found.withColumn(names["ids"], F.concat(c["access"], c["weak_id"]))
    name = lambda s: s["found"].endswith("=") & F.substring(t, s["end"] + 1, 1).rlike("[A-Za-z0-9+/_-]")  # noqa: E731  # of NAME=value
    mixed = lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Z]") & s["found"].rlike("[a-z]")
    found = found.withColumn(names["weak_secret"], _spans(t, WEAK_SECRET, F.size(names["ids"]) > 0))
    found = found.withColumn(names["weak_secret"], F.filter(_apart(c["weak_secret"], names["assign"], names["access"], names["hex"], names["weak_id"]), lambda s: mixed(s) & F.exists(names["ids"], lambda i: _near(s, i)) & ~name(s)))
    found = found.withColumn(names["secrets"], F.concat(c["assign"], c["hex"], c["weak_secret"]))
    found = found.withColumns({
        names["weak_id"]: F.filter(names["weak_id"], lambda s: F.exists(names["secrets"], lambda x: _near(s, x))),
        names["endpoint"]: F.filter(_apart(_spans(t, ENDPOINT, (F.size(names["ids"]) > 0) & (F.size(names["secrets"]) > 0)), *[names[k] for k in KINDS[:3]]), lambda s: F.exists(names["ids"], lambda x: _near(s, x)) & F.exists(names["secrets"], lambda x: _near(s, x))),
    })
    return found.select(*[found[x] for x in kept], *[F.array_sort(F.concat(*[_tagged(names[k], i) for i, k in enumerate(KINDS[:n])])).alias(name) for name, n in (("base_spans", 3), ("spans", len(KINDS)))])


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span, overlapping ones as one, replaced by its kind in brackets."""
    names = F.array(*map(F.lit, KINDS))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).otherwise(acc["out"]).alias("out"),
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)).otherwise(text)


def _sql_spans(pattern: str, kind: int, text: str = "t") -> str:
    """A list of (start, kind, end, found) of the matches, in comparison SQL."""
    p = pattern.replace("'", "''")
    part = "(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER"
    return f"list_transform(range(1, len(m) + 1), lambda i: {{'start': {part}, 'kind': {kind}, 'stop': {part} + length(m[i]), 'found': m[i]}}) FROM (SELECT doc_id, regexp_extract_all({text}, '{p}') AS m, regexp_split_to_array({text}, '{p}') AS p FROM d)"


def _oracle() -> str:
    near = "s.start <= x.stop + {0} AND x.start <= s.stop + {0}".format(SCOPE)
    apart = "NOT EXISTS (SELECT 1 FROM {0} x WHERE x.doc_id = s.doc_id AND s.start < x.stop AND x.start < s.stop)"
    with_ = lambda t: f"EXISTS (SELECT 1 FROM {t} x WHERE x.doc_id = s.doc_id AND {near})"
    raw = ", ".join(f"r{k} AS (SELECT doc_id, unnest(l, recursive := true) FROM (SELECT doc_id, {_sql_spans(p, k).replace(' FROM (SELECT', ' AS l FROM (SELECT', 1)}))" for k, p in enumerate((ASSIGN, ACCESS, HEX, SQL_WEAK_ID, SQL_WEAK_SECRET, ENDPOINT)))
    value = ASSIGN.replace("'", "''")
    mixed = f"regexp_matches(found, '{SQL_WEAK_SECRET_FORM}') AND regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]')"
    joined = lambda t: f"SELECT doc_id, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS j FROM (SELECT *, [{', '.join(repr(k) for k in KINDS)}][kind + 1] AS name FROM {t}) GROUP BY doc_id"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(KINDS[:3]))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {raw},
base AS (SELECT * FROM r0 WHERE length(regexp_extract(found, '{value}', 2)) >= {ASSIGN_LEAST} UNION ALL SELECT * FROM r1 WHERE length(found) >= {ACCESS_LEAST} UNION ALL SELECT * FROM r2 WHERE length(found) >= {HEX_LEAST}),
w3 AS (SELECT * FROM r3 s WHERE {apart.format("base")}), ids AS (SELECT * FROM base WHERE kind = 1 UNION ALL SELECT * FROM w3),
w4 AS (SELECT * FROM r4 s WHERE {apart.format("base")} AND {apart.format("w3")} AND {mixed} AND {with_("ids")}),
secrets AS (SELECT * FROM base WHERE kind IN (0, 2) UNION ALL SELECT * FROM w4),
every AS (SELECT * FROM base UNION ALL SELECT * FROM w3 s WHERE {with_("secrets")} UNION ALL SELECT * FROM w4 UNION ALL SELECT * FROM r5 s WHERE {apart.format("base")} AND {with_("ids")} AND {with_("secrets")}),
n AS (SELECT doc_id, {counts} FROM base GROUP BY doc_id), b AS ({joined("base")}), e AS ({joined("every")})
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.j, '')) AS base_sha256, coalesce(e.j, '') AS spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)
"""


ORACLE = _oracle()
