"""Secret scanning with multipart credential linking, in DataFrame expressions only.

Strong kinds (``assign``, ``access``, ``hex``) are reported wherever they stand.  Weak parts are reported only
with their complement in scope, that is with at most ``scope`` code points between them:

* ``keyid`` (a named account, client or key identifier, or a temporary key id) with a secret: ``assign``, ``hex`` or ``blob``;
* ``blob`` (a mixed-case token with digits) with an identifier: ``access`` or ``keyid``;
* ``endpoint`` (a service address) with both an identifier and a secret.

A weak part that overlaps a strong span is part of it and is not reported again.

A text is scanned once.  ``split`` and ``regexp_extract_all`` with the same pattern give the gaps before the matches and
the matches; from then on only their lengths travel, and a running sum turns them into code-point positions.
Co-occurrence is an interval join: spans are dealt to buckets of ``scope`` code points of their document, weak
spans also to the buckets that their scope reaches, and they meet by an equi-join on document and bucket.  Spans of a
kind never overlap, so a bucket holds at most a few dozen, whatever the length of the text.

Null text counts as empty.  Rows are told apart by id and text; identical rows count once while they are worked on and
are repeated in the result; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hashloom.plans.hot import fresh
from hashloom.scratch import materialize

SMALL = 1 << 20  # spans that may be broadcast

#: kind: (Java pattern, group whose length must reach the least, least length); in the order of the report.
KINDS: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
    "keyid": (r"""(?i:(access_?key_?id|client_?id|account_?id|user_?name|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]+)|ASIA[A-Z0-9]{12,}""", 0, 8),
    "blob": (r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", 0, 20),
    "endpoint": (r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mongodb|redis|s3)://[A-Za-z0-9][A-Za-z0-9._:@-]*", 0, 8),
}
STRONG = ("assign", "access", "hex")
IDENTIFIERS = ("access", "keyid")
SECRETS = ("assign", "hex", "blob")
ORDER = {kind: k for k, kind in enumerate(KINDS)}


def _matches(text: Column, kind: str) -> Column:
    """Array of ``(kind, pos, gap, size, ok)`` for one kind; empty without a match."""
    pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("s"))
    cells = F.transform(
        zipped,
        lambda x, k: F.struct(F.lit(ORDER[kind]).alias("kind"), k.cast("int").alias("pos"), F.length(x["s"]).alias("gap"), F.length(x["m"]).alias("size"), (F.length(x["v"]) >= least).alias("ok")),
    )
    # the last gap follows the last match
    return F.when(F.size(whole) > 0, F.slice(cells, 1, F.size(whole)))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, kind, start, end, times)``: every strong span and weak part, and a row of kind -1 for each text.

    ``h`` is the text's hash and ``times`` the number of identical rows.  ``kind`` numbers ``KINDS``.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    sentinel = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("pos"), F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("ok")))
    none = F.slice(sentinel, 1, 0)
    cells = F.concat(sentinel, *[F.coalesce(_matches(F.col("t"), kind), none) for kind in KINDS])
    rows = base.select("doc_id", F.xxhash64("t").alias("h"), F.explode(cells).alias("c")).select("doc_id", "h", "c.*")
    once = rows.groupBy("doc_id", "h", "kind", "pos", "gap", "size", "ok").agg(F.count(F.lit(1)).alias("times"))
    w = Window.partitionBy("doc_id", "h", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    return once.withColumn("end", end).filter("ok").select("doc_id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "times")


def link(spans: DataFrame, scope: int = 300) -> DataFrame:
    """The weak spans of ``find_spans`` whose complement is in scope and that no strong span overlaps."""
    number = lambda kinds: [ORDER[k] for k in kinds]
    key = ["doc_id", "h"]
    weak = spans.filter(F.col("kind") >= len(STRONG))
    # documents without a weak part end here
    left = weak.select(*key, F.col("kind").alias("k1"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    left = left.withColumn("bucket", F.explode(F.sequence(F.floor(F.greatest(F.col("s1") - scope, F.lit(0)) / scope), F.floor((F.col("e1") + scope) / scope))))
    right = spans.filter("kind >= 0").select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("kind").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    right = right.withColumn("b2", F.explode(F.sequence(F.floor(F.col("s2") / scope), F.floor(F.col("e2") / scope))))
    met = left.join(right, (left["h"] == right["h2"]) & (left["bucket"] == right["b2"]) & left["doc_id"].eqNullSafe(right["d2"]))
    gap = F.greatest("s1", "s2") - F.least("e1", "e2")
    near = met.filter(gap <= scope).groupBy(*key, "k1", "s1", "e1").agg(
        F.max(F.col("k2").isin(number(IDENTIFIERS))).alias("id_near"),
        F.max(F.col("k2").isin(number(SECRETS))).alias("secret_near"),
        F.max((F.col("k2") < len(STRONG)) & (gap < 0)).alias("covered"),
    )
    both = (
        ((F.col("k1") == ORDER["keyid"]) & F.col("secret_near"))
        | ((F.col("k1") == ORDER["blob"]) & F.col("id_near"))
        | ((F.col("k1") == ORDER["endpoint"]) & F.col("id_near") & F.col("secret_near"))
    )
    return near.filter(both & ~F.col("covered")).select(*key, F.col("k1").alias("kind"), F.col("s1").alias("start"), F.col("e1").alias("end"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """``(doc_id, h, times, found)`` for each distinct row: ``found`` holds ``(start, kind, end)`` by start, then kind."""
    cell = F.struct(F.col("start").alias("start"), F.col("kind").alias("kind"), F.col("end").alias("end"))
    every = reported(docs, id_col, text_col, scope).select("doc_id", "h", "times", F.when(F.col("kind") >= 0, cell).alias("cell"))
    # a kind -1 row carries the number of identical rows; strong spans repeat it and linked ones have none
    return every.groupBy("doc_id", "h").agg(F.max("times").alias("times"), F.array_sort(F.collect_list("cell")).alias("found"))


def reported(docs: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    """``(doc_id, h, kind, start, end, times)`` of all spans to report, and a row of kind -1 for each text."""
    spans, _ = materialize(find_spans(docs, id_col, text_col), "spans")
    strong = spans.filter(F.col("kind") < len(STRONG))
    return strong.unionByName(link(spans, scope).withColumn("times", F.lit(0).cast("long")))


def _named(cells: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", name(c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """Counts of the strong kinds, the hash of their list, and all spans as text, for every row of ``docs``."""
    found = find_secrets(docs, id_col, text_col, scope)
    of = lambda kind: F.size(F.filter("found", lambda c: c["kind"] == ORDER[kind])).cast("long").alias(f"n_{kind}")
    strong = F.filter("found", lambda c: c["kind"] < len(STRONG))
    out = found.select("doc_id", *[of(k) for k in STRONG], F.sha2(_named(strong), 256).alias("base_sha256"), _named(F.col("found")).alias("spans"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("_copy"))
    return out.drop("_copy")


def merged(spans: DataFrame) -> DataFrame:
    """``(doc_id, h, cuts)``: the texts' spans with overlapping ones made one, as ``(start, end)`` in order; texts without spans have no row."""
    w = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    led = spans.filter("kind >= 0").withColumn("first", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    numbered = led.withColumn("number", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = numbered.groupBy("doc_id", "h", "number").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"))
    return one.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def _without(text: Column, cuts: Column, mark: str) -> Column:
    """``text`` with ``mark`` for each of the ``cuts``.

    Taking a part of a text costs its distance from the text's beginning.  So the text is first taken apart into stretches of about
    the square root of the number of cuts, and each stretch by its own cuts.
    """
    n = F.size(cuts)
    step = F.ceil(F.sqrt(n)).cast("int")
    part = lambda t, low, high: F.when(high > low, F.substring(t, low + 1, high - low)).otherwise(F.lit(""))
    end_of = lambda k: F.when(k > 0, F.get(cuts, k - 1)["end"]).otherwise(F.lit(0))

    def stretch(g: Column) -> Column:
        first, last = g * step, F.least((g + 1) * step, n)
        own = F.struct(part(text, end_of(first), end_of(last)).alias("t"), end_of(first).alias("at"))
        # an array of one cell, so that the stretch is taken out of the text once
        pieces = F.transform(F.array(own), lambda o: F.array_join(F.transform(F.sequence(first, last - 1), lambda k: F.concat(part(o["t"], end_of(k) - o["at"], F.get(cuts, k)["start"] - o["at"]), F.lit(mark))), ""))
        return F.get(pieces, F.lit(0))

    inner = F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1), stretch)
    return F.concat(F.array_join(inner, ""), part(text, end_of(n), F.length(text)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text_col`` replaced by ``mark`` (overlapping spans by one); other columns as they are.

    The texts stay where they are: the spans, few beside the texts, come to them by broadcast while there are ``SMALL`` or fewer, beyond that by a join.
    """
    spans, _ = materialize(merged(reported(docs, id_col, text_col, scope)), "cuts")
    i, h, c = fresh(docs.columns, "span_id", "span_hash", "span_cuts")
    found = spans.select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("cuts").alias(c))
    if (spans.agg(F.sum(F.size("cuts"))).first()[0] or 0) <= SMALL:
        found = F.broadcast(found)
    text = F.col(text_col)
    joined = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(h)), "left")
    return joined.withColumn(text_col, F.when(F.col(c).isNotNull(), _without(text.cast("string"), F.col(c), mark)).otherwise(text)).select(*docs.columns)


def oracle_sql(scope: int = 300) -> str:
    """The result of ``report`` as DuckDB SQL over ``documents`` (its patterns have no look-around; runs are filtered instead)."""
    plain = {k: v[0] for k, v in KINDS.items()} | {"blob": r"[A-Za-z0-9+/_-]{20,}"}
    per = []
    for kind, (_, group, least) in KINDS.items():
        p = plain[kind].replace("'", "''")
        ok = f"length(v) >= {least}" + (" and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')" if kind == "blob" else "")
        per.append(
            f"select rn, kind, s_end - length(m) as s, s_end as e from (select rn, {ORDER[kind]} kind, m, v, sum(length(g) + length(m)) over (partition by rn order by pos) s_end from "
            f"(select rn, unnest(m) m, unnest(v) v, unnest(g[1:len(m)]) g, generate_subscripts(m, 1) pos from (select rn, regexp_extract_all(t, '{p}', 0) m, regexp_extract_all(t, '{p}', {group}) v, regexp_split_to_array(t, '{p}') g from d) where len(m) > 0)) where {ok}"
        )
    n = len(STRONG)
    name = "['" + "', '".join(KINDS) + "'][kind + 1]"
    ids, secs = (", ".join(str(ORDER[k]) for k in x) for x in (IDENTIFIERS, SECRETS))
    return f"""
    with d as (select row_number() over () rn, doc_id, coalesce(text, '') t from documents),
    sp as ({" union all ".join(per)}),
    near as (select a.rn, a.kind, a.s, a.e, bool_or(b.kind in ({ids})) id_near, bool_or(b.kind in ({secs})) secret_near, bool_or(b.kind < {n} and greatest(a.s, b.s) < least(a.e, b.e)) covered
             from sp a join sp b on a.rn = b.rn and a.kind >= {n} and greatest(a.s, b.s) - least(a.e, b.e) <= {scope} group by all),
    al as (select rn, kind, s, e from sp where kind < {n} union all select rn, kind, s, e from near where not covered and
           (kind = {ORDER["keyid"]} and secret_near or kind = {ORDER["blob"]} and id_near or kind = {ORDER["endpoint"]} and id_near and secret_near)),
    g as (select rn, string_agg({name} || ':' || s || ':' || e, ',' order by s, kind) spans, string_agg({name} || ':' || s || ':' || e, ',' order by s, kind) filter (where kind < {n}) base,
          count(*) filter (where kind = 0) n0, count(*) filter (where kind = 1) n1, count(*) filter (where kind = 2) n2 from al group by rn)
    select doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join g using (rn)"""
