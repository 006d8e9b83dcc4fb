"""Secret scans with multipart credential linking (DataFrame functions only).

Assignments, access identifiers and long hex strings are found in every text.  Weak candidates mean little
alone: bare secrets, other identifiers (of clients, accounts, temporary keys, e-mail addresses) and endpoints (URLs, IP
addresses, named hosts).  They are joined by overlapping intervals within a scope and reported only where the complementary
parts are there: a secret beside an identifier, an identifier beside a secret, an endpoint beside both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

#: Fixed patterns of the base kinds, in their order, with the group and length that a match must have.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak candidates.
SECRET = r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40}|[A-Za-z0-9+/]{86}==)(?![A-Za-z0-9+/=])"
NAMED = r"""(?i:client_?id|account_?(?:id|name)|access_?key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}|(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16}(?![A-Za-z0-9])"""
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
IDENTIFIER = f"{NAMED}|{MAIL}"
ENDPOINT = r"""https?://[^\s"'<>]{4,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])|(?i:host_?(?:name)?|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}"""
KINDS = ("assign", "access", "hex", "secret", "identifier", "endpoint")
#: Running positions are summed in blocks of so many matches.
BLOCK = 256


def spans(text: Column, pattern: str, guard: Column, group: int = 0, least: int = 1) -> Column:
    """array<struct<start, end>> of the matches, in code points; those whose group is shorter than ``least`` are dropped.

    Matches and the pieces between them alternate, so their running lengths are the positions. These are summed in
    blocks, and over the blocks: arrays that grow by one are copied each time, so they are kept short.
    """
    p = F.lit(pattern)
    found, width, gaps = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group)), F.split(text, pattern, -1)
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  # a value used in an inner function is made once
    lengths = F.transform(F.arrays_zip(found.alias("m"), width.alias("w"), gaps.alias("gap")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("n"), F.length(x["w"]).alias("g")))
    # behind the last match stands a gap of its own
    total = once(lengths, lambda all_: _positions(F.slice(all_, 1, F.greatest(F.size(all_) - 1, F.lit(0)))))
    kept = F.transform(F.filter(total, lambda s: s["g"] >= least), lambda s: F.struct(s["start"], s["end"]))
    return F.when(guard, kept).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _positions(sized: Column) -> Column:
    """array<struct<gap, n, g>> -> array<struct<start, end, g>> of running lengths."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(sized) / BLOCK).cast("int")), lambda b: F.slice(sized, b * BLOCK + 1, F.lit(BLOCK)))
    each = F.transform(blocks, lambda b: F.struct(b.alias("of"), F.aggregate(b, F.lit(0), lambda a, m: a + m["gap"] + m["n"]).alias("sum")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<of:array<struct<gap:int,n:int,g:int>>,at:int>>").alias("all"))
    placed = F.aggregate(each, begin, lambda a, b: F.struct((a["at"] + b["sum"]).alias("at"), F.concat(a["all"], F.array(F.struct(b["of"].alias("of"), a["at"].alias("at")))).alias("all")), lambda a: a["all"])

    def positions(b: Column) -> Column:
        none = F.array().cast("array<struct<start:int,end:int,g:int>>")
        step = lambda a, m: F.struct((a["at"] + m["gap"] + m["n"]).alias("at"), F.concat(a["all"], F.array(F.struct((a["at"] + m["gap"]).alias("start"), (a["at"] + m["gap"] + m["n"]).alias("end"), m["g"].alias("g")))).alias("all"))
        return F.aggregate(b["of"], F.struct(b["at"].alias("at"), none.alias("all")), step, lambda a: a["all"])

    return F.flatten(F.transform(placed, positions))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row (a number of its own) and the spans of each kind, without linking."""
    t = F.col("text")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = texts.withColumn("named", t.rlike(NAMED) | (t.contains("@") & t.rlike(MAIL))).withColumn("known", F.col("named") | t.contains("AKIA"))
    return named.select(
        "id", F.monotonically_increasing_id().alias("row"),
        spans(t, ASSIGN, t.rlike("(?i:passw|secret|token|api_?key)"), 2, 6).alias("assign"),
        spans(t, ACCESS, t.contains("AKIA")).alias("access"),
        spans(t, HEX, t.rlike(HEX)).alias("hex"),
        spans(t, SECRET, F.col("known")).alias("secret"),
        spans(t, IDENTIFIER, F.col("named")).alias("identifier"),
        spans(t, ENDPOINT, F.col("known") & t.rlike(ENDPOINT)).alias("endpoint"),
    )


def _parts(found: DataFrame, kind: str, scope: int, around: bool = False) -> DataFrame:
    """row, cell, start, end of a kind's spans in all cells they touch; with ``around`` in those at most ``scope`` away, too."""
    each = found.select("row", F.explode(kind).alias("s"))
    first, last = F.floor((F.col("s.start") - (scope if around else 0)) / scope), F.floor((F.col("s.end") + (scope if around else 0)) / scope)
    return each.select("row", F.explode(F.sequence(first, last)).alias("cell"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def _near(weak: DataFrame, strong: DataFrame, scope: int) -> DataFrame:
    """The weak spans with a strong one at most ``scope`` code points away."""
    w, s = weak.alias("w"), strong.alias("s")
    gap = F.greatest(F.col("s.start") - F.col("w.end"), F.col("w.start") - F.col("s.end"))
    return w.join(s, (F.col("w.row") == F.col("s.row")) & (F.col("w.cell") == F.col("s.cell")) & (gap <= scope), "left_semi")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 256) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base_sha256, spans, found.

    found is an array of (start, end, kind): base spans and those that linking adds (secret, identifier,
    endpoint), by start, then kind in the order of KINDS. Two spans are near when at most ``scope`` code points lie between them.
    A secret needs an access id or identifier near, an identifier an assignment, secret or hex string, an endpoint one of each.
    Null texts are empty. Repeated rows are rows of their own. Other columns are ignored. An empty table gives no rows.
    """
    found = materialize(scan(docs, id_col, text_col), "secrets")
    some = found.where("size(access) + size(identifier) > 0")
    who = _parts(some, "access", scope, around=True).unionByName(_parts(some, "identifier", scope, around=True))
    what = _parts(some, "assign", scope, around=True).unionByName(_parts(some, "secret", scope, around=True)).unionByName(_parts(some, "hex", scope, around=True))
    secret = _near(_parts(some, "secret", scope), who, scope)
    identifier = _near(_parts(some, "identifier", scope), what, scope)
    endpoint = _near(_near(_parts(some, "endpoint", scope), who, scope), what, scope)
    linked = secret.withColumn("k", F.lit(3)).unionByName(identifier.withColumn("k", F.lit(4))).unionByName(endpoint.withColumn("k", F.lit(5)))
    linked = linked.groupBy("row").agg(F.collect_set(F.struct("start", "k", "end")).alias("linked"))  # parts of one text
    of = lambda kind, k: F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))
    base = F.array_sort(F.concat(of("assign", 0), of("access", 1), of("hex", 2)))
    out = found.join(linked, "row", "left").withColumn("base", base)
    out = out.withColumn("all", F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast("array<struct<start:int,k:int,end:int>>")))))
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(
        F.col("id").alias(id_col),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.encode(text("base"), "UTF-8"), 256).alias("base_sha256"),
        text("all").alias("spans"),
        F.transform("all", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["k"]).alias("kind"))).alias("found"),
    )
