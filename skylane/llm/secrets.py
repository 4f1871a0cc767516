"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong parts (an assignment, an access identifier, a long hex run) are reported wherever they stand. Weak parts (the
setting of an identifier, user name or address, a key identifier, a bare mixed key, a name with its password in a
connection string, an endpoint) are reported only where complementary parts stand within the same scope: parts are exploded to buckets one scope wide and joined on text and bucket, so no two parts are compared unless
they are neighbours.

Spans count code points; ends are exclusive. A text's places come from running lengths of its matches and of what
stands between them; running values are taken in blocks of the square root of their number, as appending to a list
would copy it for every match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.staging import staged

_ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ID = "(?i:(user_?name|login|email|user(?==)|(?:user|client|access|account|tenant|key)_?id))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)"
#: Key identifiers of other stores, connection strings, hosts with a port. All repetitions before a fixed character are bounded, so a search is linear.
_KEY_ID = "(?:ASIA|AIDA|AROA|LTAI|GOOG)[A-Z0-9]{12,}"
_SCHEMES = "(?:https?|wss?|s?ftps?|ssh|s3a?|jdbc:[a-z]{2,15}|postgres(?:ql)?|mysql|mariadb|mongodb(?:\\+srv)?|rediss?|amqps?)"
_ENDPOINT = f"{_SCHEMES}://[^\\x00-\\x20\"'<>]+|(?<![A-Za-z0-9.-])[A-Za-z0-9-]{{1,63}}(?:\\.[A-Za-z0-9-]{{1,63}}){{1,8}}:[0-9]{{2,5}}"
_LOGIN = "(?<=://)[^\\x00-\\x20/:@\"'<>]{1,64}:[^\\x00-\\x20/@\"'<>]{4,128}@"
#: kind: pattern, group that is measured, its least length. Hex and access runs are greedy, so a bound in the pattern drops what a later check would.
STRONG = {"assign": (_ASSIGN, 2, 12), "access": ("AKIA[A-Z0-9]{14,}", 0, 18), "hex": ("[0-9a-f]{16,}", 0, 16)}
WEAK = {
    "id": (_ID, 2, 4), "key": ("[A-Za-z0-9+/_-]{24,}={0,2}", 0, 24), "endpoint": (_ENDPOINT, 0, 10),
    "key_id": (_KEY_ID, 0, 16), "login": (_LOGIN, 0, 7),
}
#: What a part can complete: identifiers and secrets.
_ROLE = {"access": "id", "id": "id", "key_id": "id", "assign": "secret", "hex": "secret", "key": "secret", "login": "login", "endpoint": "endpoint"}
#: Weak kinds that name who signs in; the others are only looked for where one of these or a strong identifier stands.
_NAMES = ("id", "key_id", "login")
#: Parts of one credential stand less than this many code points apart.
SCOPE = 256

_NONE = "cast(array() as array<struct<start: int, ord: int, end: int, kind: string>>)"
#: Code points in which a text is cut up before parts of it are copied out.
_CUT = 1024


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _quotient(i: Column, n: Column | int) -> Column:
    return F.floor(i / n).cast("int")


def _before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine`` makes of all numbers before each one (0 before the first), for an array of int that isn't empty."""
    fold = lambda part: F.aggregate(part, F.lit(0), combine)

    def of(v: Column, b: Column) -> Column:
        last = _quotient(F.size(v) - 1, b)
        sums = F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(v, k * b + 1, b)))
        whole = _let(sums, lambda s: F.transform(s, lambda _, k: fold(F.slice(s, F.lit(1), k))))
        return _let(whole, lambda w: F.transform(v, lambda _, i: combine(F.get(w, _quotient(i, b)), fold(F.slice(v, _quotient(i, b) * b + 1, i - _quotient(i, b) * b)))))

    return _let(values, lambda v: _let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda b: of(v, b)))


def _mixed(value: Column) -> Column:
    """A bare key has a digit and letters of both cases."""
    return value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")


def _found(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose measured group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    good = lambda v: (F.length(v) >= least) & _mixed(v) if kind == "key" else F.length(v) >= least
    matches = F.zip_with(whole, part, lambda m, v: F.struct(F.length(m).alias("m"), good(v).alias("good")))
    # split() gives the text between the matches, the last piece without one.
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda s, x: F.struct(F.length(s).alias("s"), x["m"].alias("m"), x["good"].alias("good")))

    def spans(v: Column) -> Column:
        at = _before(F.transform(v, lambda x: x["s"] + F.coalesce(x["m"], F.lit(0))), lambda a, b: a + b)
        placed = F.zip_with(v, at, lambda x, a: F.struct((a + x["s"]).alias("start"), F.lit(order).alias("ord"), (a + x["s"] + x["m"]).alias("end"), F.lit(kind).alias("kind"), x["good"].alias("good")))
        return F.transform(F.filter(placed, lambda x: x["good"]), lambda x: F.struct(*[x[c].alias(c) for c in ("start", "ord", "end", "kind")]))

    return F.when(text.rlike(pattern), _let(steps, spans)).otherwise(F.expr(_NONE))


def _ends_before(spans: Column) -> Column:
    """The largest end among the spans before each one."""
    return _before(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))


def _clear(weak: Column, base: Column) -> Column:
    """Those weak spans that no strong span overlaps; both are in order of start."""
    # Strong starts and weak ends in one order: what stands before a weak end and isn't a weak end is a strong span that starts before it.
    marks = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("of"), b.alias("w"))), F.transform(weak, lambda w: F.struct(w["end"].alias("at"), F.lit(0).alias("of"), w.alias("w")))))
    ends = F.filter(F.transform(marks, lambda x, i: F.struct(x["of"].alias("of"), x["w"].alias("w"), i.alias("i"))), lambda x: x["of"] == 0)
    known = F.transform(ends, lambda x, j: F.struct(x["w"].alias("w"), (x["i"] - j).alias("k")))
    # The largest end of the first k strong spans; one more entry stands for all of them.
    upto = _ends_before(F.array_append(base, F.struct(F.lit(0).alias("start"), F.lit(0).alias("ord"), F.lit(0).alias("end"), F.lit("").alias("kind"))))
    return _let(upto, lambda e: F.transform(F.filter(known, lambda x: F.get(e, x["k"]) <= x["w"]["start"]), lambda x: x["w"]))


def _with_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) plus ``base`` (strong spans in order), ``weak`` and ``may`` (weak parts have something to go with)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = [_found(text, k, n, *rule) for n, (k, rule) in enumerate(STRONG.items())]
    weak = {k: _found(text, k, n + len(STRONG), *rule) for n, (k, rule) in enumerate(WEAK.items())}
    out = rows.withColumn("base", F.sort_array(F.concat(*strong))).withColumn("names", F.concat(*[weak[k] for k in _NAMES]))
    # An identifier must stand somewhere, strong or weak; only then are other weak parts looked for.
    has_id = F.exists("base", lambda b: b["kind"] == "access") | (F.size("names") > 0)
    every = F.sort_array(F.concat("names", *[found for k, found in weak.items() if k not in _NAMES]))
    out = out.withColumn("weak", F.when(has_id, every).otherwise(F.expr(_NONE))).drop("names")
    out = out.withColumn("weak", F.when(F.size("weak") > 0, _clear(F.col("weak"), F.col("base"))).otherwise(F.expr(_NONE)))
    # Without the last condition, which always holds, a filter on this column would be pushed below all of these columns, each written out anew wherever it is used.
    return out.withColumn("may", (F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1) & (F.spark_partition_id() >= 0))


def _linked(parts: DataFrame, keys: list[str], scope: int) -> DataFrame:
    """Weak spans with complementary parts in scope: ``keys, more``. ``parts`` holds ``keys, base, weak``."""
    role = F.create_map(*[F.lit(x) for kv in _ROLE.items() for x in kv])
    bucket = lambda c, d: F.floor((F.col(c) + d) / scope).cast("int")
    weak = parts.select(*keys, F.explode("weak").alias("w")).select(*keys, "w", "w.start", "w.end")
    weak = weak.withColumn("bucket", F.explode(F.sequence(bucket("start", -scope), bucket("end", scope - 1))))
    other = parts.select(*keys, F.explode(F.concat("base", "weak")).alias("p")).select(*keys, "p", F.col("p.start").alias("from"), F.col("p.end").alias("to"))
    other = other.where(F.col("p.kind").isin(list(_ROLE))).withColumn("bucket", F.explode(F.sequence(bucket("from", 0), bucket("to", -1))))
    same = [weak[k].eqNullSafe(other[k]) for k in keys]
    near = (F.col("from") - F.col("end") < scope) & (F.col("start") - F.col("to") < scope) & (F.col("p") != F.col("w"))
    met = weak.join(other, [*same, weak["bucket"] == other["bucket"], near]).select(*[weak[k] for k in keys], "w", role[F.col("p.kind")].alias("role"))
    roles = met.groupBy(*keys, "w").agg(*[F.max(F.col("role") == r).alias(f"has_{r}") for r in ("id", "secret", "login", "endpoint")])
    complete = (
        F.when(F.col("w.kind") == "key", F.col("has_id"))
        .when(F.col("w.kind").isin("id", "key_id"), F.col("has_secret"))
        .when(F.col("w.kind") == "login", F.col("has_endpoint"))
        .otherwise(F.col("has_login") | (F.col("has_id") & F.col("has_secret")))
    )
    return roles.where(complete).groupBy(*keys).agg(F.collect_list("w").alias("more"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _all_spans(base: Column, more: Column) -> Column:
    return F.sort_array(F.concat(base, F.coalesce(more, F.expr(_NONE))))


def secret_spans(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every text: ``doc_id, base, spans``, arrays of ``(start, ord, end, kind)`` in order of start and kind.

    ``base`` holds the strong spans, ``spans`` also the weak ones that complementary parts support. Spans that start at
    the same place come in the order in which the kinds are listed. A null or empty text has none. One row comes back for
    each row of ``docs``; rows with equal id and text have equal results, a null id is kept. An empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _with_parts(rows).select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "base", "weak", "may")
    found = staged(found, "secret-parts")
    keys = ["doc_id", "h", "n"]
    plain = found.where("not may").select("doc_id", "base", F.col("base").alias("spans"))
    asked = found.where("may")
    more = _linked(asked.select(*keys, "base", "weak").distinct(), keys, scope)
    joined = asked.alias("d").join(more.alias("m"), [F.col(f"d.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys], "left")
    return plain.union(joined.select("d.doc_id", "d.base", _all_spans(F.col("d.base"), F.col("m.more"))))


def secret_report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Digest of :func:`secret_spans`: counts of the strong kinds, a digest of the strong spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secret_spans(docs, scope).select(
        "doc_id", *[count(k) for k in STRONG], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )


def _masked(text: Column, spans: Column) -> Column:
    """``text`` with each run of overlapping spans replaced by its first kind in square brackets."""

    def cut(parts: Column, start: Column, end: Column) -> Column:
        """Code points from ``start`` to ``end`` of a text that stands in parts of ``_CUT``."""
        of = lambda k: F.substring(F.get(parts, k), F.greatest(start - k * _CUT, F.lit(0)) + 1, F.least(end - k * _CUT, F.lit(_CUT)) - F.greatest(start - k * _CUT, F.lit(0)))
        return F.when(end > start, F.array_join(F.transform(F.sequence(_quotient(start, _CUT), _quotient(end - 1, _CUT)), of), "")).otherwise("")

    def joined(s: Column, ends: Column, parts: Column) -> Column:
        # A span begins a run if it starts at or after all earlier ends; the run before it ends at the largest of them.
        marked = F.zip_with(s, ends, lambda x, e: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), e.alias("before")))
        runs = F.filter(marked, lambda x: x["start"] >= x["before"])
        body = F.transform(runs, lambda r: F.concat(cut(parts, r["before"], r["start"]), F.lit("["), r["kind"], F.lit("]")))
        last = F.greatest(F.array_max(ends), F.get(s, F.size(s) - 1)["end"])
        return F.concat(F.array_join(body, ""), cut(parts, last, F.length(text)))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))
    done = _let(spans, lambda s: _let(_ends_before(s), lambda e: _let(parts, lambda p: joined(s, e, p))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, scope: int = SCOPE, text_col: str = "text") -> DataFrame:
    """``docs`` with every reported secret replaced by its kind in square brackets; all rows and other columns stay.

    Of spans that overlap the first one (at the same place the kind listed first) names the replacement. Null and empty
    texts stay as they are. Only rows that hold weak parts are matched with the links found for their text; all others
    are rewritten where they are read, without a shuffle.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.length(text_col).alias("n"))
    found = _with_parts(rows)
    keys = ["h", "n"]
    asked = found.where("may")
    more = _linked(asked.select(*keys, "base", "weak").distinct(), keys, scope)
    whole = lambda spans: [_masked(F.col("text"), spans).alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns]
    plain = found.where("not may").select(*whole(F.col("base")))
    joined = asked.join(more.select(F.col("h").alias("mh"), F.col("n").alias("mn"), "more"), F.expr("h = mh and n <=> mn"), "left")
    joined = joined.withColumn("spans", _all_spans(F.col("base"), F.col("more")))
    return plain.union(joined.select(*whole(F.col("spans"))))
