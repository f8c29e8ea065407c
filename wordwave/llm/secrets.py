"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns are reported wherever they match.  Weak candidates (key names'
identifiers, bare tokens, endpoints) are reported only where complementary
parts stand within their scope: an interval join of the parts of a text, whole
intervals widened by the scope, over buckets of positions.  It also says which
identifier, secret and endpoint go together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Characters before and after a part in which its complements count.
SCOPE = 400

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the runs of AKIA[A-Z0-9]+ that have 18 characters or more
HEX = r"[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that have 16 characters or more
KEY_ID = r"""(?i:(?:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user(?:name)?|login))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}"""
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/=_-])"  # of any length, with padding
ENDPOINT = r"""(?i:https?|wss?|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\s"'<>]{4,}"""
KINDS = ("assign", "access", "hex", "key_id", "weak_secret", "endpoint")
ROLES = ("secret", "identifier", "secret", "identifier", "secret", "endpoint")  # of the kinds
_BLOCK = 256


def _escaped(pattern: str) -> Column:
    return F.lit(pattern)


def located(text: Column, pattern: str, found: Column, kind: str) -> Column:
    """array<struct<start, kind, end>> of the leftmost non-overlapping matches ``found`` of ``pattern``.

    Starts are prefix sums of the lengths of gaps (the text split at the
    pattern) and matches, in code points; sums run over blocks, so that many
    matches in one text do not cost their square.
    """
    gaps = F.split(text, pattern, -1)
    steps = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    return F.when(F.size(found) > 0, steps)


def _spans(steps: Column, kind: int) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x["gap"] + x["size"])
    n = F.size(steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(steps, b * _BLOCK + 1, _BLOCK)))
    bases = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0).cast("long"), lambda acc, x: acc + x))

    def one(x, i):
        block = F.floor(i / _BLOCK).cast("int")
        start = F.get(bases, block) + total(F.slice(steps, block * _BLOCK + 1, i - block * _BLOCK)) + x["gap"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).alias("end"))

    return F.when(steps.isNotNull(), F.transform(steps, one)).otherwise(F.array().cast("array<struct<start:long,kind:int,end:long>>"))


def base_and_weak(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, key2, base, weak): arrays of located base spans and of weak candidates; the keys are hashes of id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    hint = F.col("low").rlike("password|passwd|secret|token|api_?key")
    url = F.col("low").contains("://")
    named = F.col("low").rlike("id|user|login")
    none = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id",
        "text",
        F.when(hint, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(0))).otherwise(none).alias("m0"),
        F.when(hint, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("v0"),
        F.when(F.col("text").contains("AKIA"), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0))).otherwise(none).alias("m1"),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)).alias("m2"),
        F.when(named, F.regexp_extract_all("text", F.lit(KEY_ID), F.lit(0))).otherwise(none).alias("m3"),
        F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("m4"),
        F.when(url, F.regexp_extract_all("text", F.lit(ENDPOINT), F.lit(0))).otherwise(none).alias("m5"),
    )
    patterns = (ASSIGN, ACCESS, HEX, KEY_ID, TOKEN, ENDPOINT)
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text", "doc_id").alias("key2"), "v0", *(located(F.col("text"), p, F.col(f"m{k}"), KINDS[k]).alias(f"g{k}") for k, p in enumerate(patterns)))
    rows = rows.select("doc_id", "key", "key2", "v0", *(_spans(F.col(f"g{k}"), k).alias(f"s{k}") for k in range(6)))
    strong = F.filter(F.col("s0"), lambda x, i: F.length(F.get(F.col("v0"), i)) >= 12)
    short = F.transform(F.filter(F.col("s0"), lambda x, i: F.length(F.get(F.col("v0"), i)).between(6, 11)), lambda x: F.struct(x["start"], F.lit(4).alias("kind"), x["end"]))
    return rows.select("doc_id", "key", "key2", F.concat(strong, "s1", "s2").alias("base"), F.concat(short, "s3", "s4", "s5").alias("weak"))


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Parts (key, key2, start, kind, end) that have complements, with the nearest part of every other role in scope.

    Columns identifier, secret and endpoint are structs (gap, start, kind, end),
    null where none is in scope; of equally near ones the earlier counts.  Two
    parts are in scope if at most ``scope`` characters lie between them, whole
    intervals counted.  An identifier needs a secret; a secret needs an
    identifier or an endpoint; an endpoint needs an identifier and a secret.

    The join is on text and bucket of positions: a part is in the buckets that
    it touches, and looks in those that its widened interval touches; a pair
    counts in the first bucket that both are in.  Parts of a kind do not
    overlap, so a text's pairs are in proportion to its length.
    """
    role = F.element_at(F.array(*(F.lit(r) for r in ROLES)), F.col("kind") + 1)
    rows = parts.select("key", "key2", "start", "kind", "end", role.alias("role"))
    width = 2 * scope + 1
    bucket = lambda x: F.floor(x / width)
    here = rows.withColumns({"low": bucket(F.col("start") - scope), "high": bucket(F.col("end") + scope)})
    here = here.withColumn("bucket", F.explode(F.sequence("low", "high")))
    there = rows.select("key", "key2", *(F.col(c).alias(f"{c}_2") for c in ("start", "kind", "end", "role")))
    there = there.withColumns({"low_2": bucket(F.col("start_2"))}).withColumn("bucket", F.explode(F.sequence("low_2", bucket(F.col("end_2")))))
    gap = F.greatest(F.col("start_2") - F.col("end"), F.col("start") - F.col("end_2"), F.lit(0))
    pairs = here.join(there, ["key", "key2", "bucket"]).where((F.col("role") != F.col("role_2")) & (gap <= scope) & (F.col("bucket") == F.greatest("low", "low_2")))
    other = F.struct(gap.alias("gap"), F.col("start_2").alias("start"), F.col("kind_2").alias("kind"), F.col("end_2").alias("end"))
    found = pairs.groupBy("key", "key2", "start", "kind", "end", "role").agg(*(F.min(F.when(F.col("role_2") == r, other)).alias(r) for r in ("identifier", "secret", "endpoint")))
    complete = {"identifier": F.col("secret").isNotNull(), "secret": F.col("identifier").isNotNull() | F.col("endpoint").isNotNull(), "endpoint": F.col("identifier").isNotNull() & F.col("secret").isNotNull()}
    test = F.lit(False)
    for r, needs in complete.items():
        test = test | ((F.col("role") == r) & needs)
    return found.where(test).drop("role")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, linked, links): base spans, linked weak spans, and who goes with whom, of every whole text, ordered by start, then kind.

    Spans are structs (start, kind, end) in code points, end exclusive, kind a
    place in :data:`KINDS`.  ``links`` holds every part with complements, base
    or weak, with the nearest identifier, secret and endpoint in scope.  Null and empty texts have none; repeated rows and
    null ids are kept; a weak part that a base span covers is not repeated;
    other columns are ignored; an empty table gives an empty result.

    Scale: texts are matched where they are read and never shuffled; the spans
    are written once, and only parts of texts with two of them or more reach
    the join, keyed by text and position.
    """
    kept = materialise(base_and_weak(docs, id_col, text_col))
    parts = kept.where("size(base) + size(weak) > 1").select("key", "key2", F.explode(F.concat("base", "weak")).alias("p")).select("key", "key2", "p.start", "p.kind", "p.end").distinct()
    near = F.struct("start", "kind", "end", "identifier", "secret", "endpoint")
    linked = linked_parts(parts, scope).groupBy("key", "key2").agg(F.array_sort(F.collect_list(near)).alias("found"))
    joined = kept.join(linked, ["key", "key2"], "left")
    span = "array<struct<start:long,kind:int,end:long>>"
    weak = F.transform(F.filter("found", lambda w: w["kind"] >= 3), lambda w: F.struct(w["start"], w["kind"], w["end"]))
    outside = F.filter(F.coalesce(weak, F.array().cast(span)), lambda w: ~F.exists("base", lambda b: (b["start"] <= w["start"]) & (b["end"] >= w["end"])))
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(outside).alias("linked"), F.coalesce("found", F.array()).alias("links"))


def links_text(links: Column) -> Column:
    """``part>partner+partner`` of each link, comma-joined, every one as ``kind:start:end``."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.when(s.isNotNull(), F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(F.transform(links, lambda s: F.concat(one(s), F.lit(">"), F.concat_ws("+", one(s["identifier"]), one(s["secret"]), one(s["endpoint"])))), ",")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
