"""Operator 2: secret scan with multipart credential linking.

Base spans are the leftmost non-overlapping matches of three patterns
(``assign``, ``access``, ``hex``) that are long enough. Weak candidates are parts
that mean little alone: an account name (``account``), a short secret value
(``short``, an assignment below the base length) and an endpoint (``endpoint``).
They are reported only when a complementary part lies within ``SCOPE`` code
points: an account needs a secret, a short secret needs an identifier, an
endpoint needs either. That is an interval join of the parts inside a text:
parts are binned by ``SCOPE``, each (text, bin, role) keeps its first and last
start, and a candidate meets its own bin and the two beside it, so it is linear
in the number of parts.

Matches are placed without a UDF: splitting a text at a pattern gives the pieces
between its matches, and running sums of the lengths give code-point offsets.
Only texts with any part enter this; a text's key is its id and digest.

Defined results: a null text is empty; texts without parts have count 0, an empty
span string and its digest; rows that repeat id and text get the same values.
Letters of the assignment keywords match in either case (ASCII). An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_of

SCOPE = 200
VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)" + VALUE
#: AKIA and 14 or more: a run that is too short holds no longer one further on.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ACCOUNT = r"(?i)(user_?name|user_?id|login|account|client_?id|access_?key_?id)" + VALUE
ENDPOINT = r"""https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|(?i:endpoint|host|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(:[0-9]+)?"""
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "account", "short", "endpoint")
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "account": ACCOUNT, "endpoint": ENDPOINT}
#: What a reader can look for first: any part's fixed letters.
ANY = ("(?i:password|passwd|secret|token|api_?key|user_?name|user_?id|login|account|client_?id|access_?key_?id"
       "|endpoint|host|server)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|https?://")


def _matches(texts: DataFrame) -> DataFrame:
    """doc_id, digest, kind, start, end, value_length of every match."""
    parts = []
    for kind, pattern in PATTERNS.items():
        p = F.lit(pattern)
        group = F.regexp_extract_all("text", p, F.lit(2)) if kind in ("assign", "account") else None
        between = F.transform(F.split("text", pattern, -1), lambda x: F.char_length(x).cast("long"))
        hits = F.transform(F.regexp_extract_all("text", p, F.lit(0)), lambda x: F.char_length(x).cast("long"))
        values = F.transform(group, lambda x: F.char_length(x).cast("long")) if group is not None else hits
        parts.append(F.struct(F.lit(kind).alias("kind"), F.arrays_zip(
            F.slice(between, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value")).alias("m")))
    each = texts.select("doc_id", "digest", F.explode(F.array(*parts)).alias("k"))
    each = each.select("doc_id", "digest", F.col("k.kind").alias("kind"), F.posexplode("k.m").alias("pos", "m"))
    along = Window.partitionBy("doc_id", "digest", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.col("m.gap") + F.col("m.hit")).over(along)
    return each.select("doc_id", "digest", "kind", (upto - F.col("m.hit")).alias("start"), upto.alias("end"),
                       F.col("m.value").alias("value_length"))


def linked_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, digest, kind, start, end, base: base spans and the weak
    candidates whose complementary parts co-occur."""
    texts = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
             .filter(F.col("text").rlike(ANY)).distinct()
             .withColumn("digest", F.sha2("text", 256)))
    found = _matches(texts)
    found = found.withColumn("kind", F.when((F.col("kind") == "assign") & (F.col("value_length") < 12), "short")
                             .otherwise(F.col("kind")))
    secret, ident = F.col("kind").isin("assign", "short"), F.col("kind").isin("access", "account")
    role = F.when(secret, "secret").when(ident, "id").otherwise("other")
    found = materialize(found.withColumns({"role": role, "bin": F.floor(F.col("start") / scope)}), "op2-parts")
    # complementary parts: first and last start by text, bin and role
    bins = (found.filter("role <> 'other'").groupBy("doc_id", "digest", "bin")
            .agg(*[agg(F.when(F.col("role") == r, F.col("start"))).alias(f"{r}_{name}")
                   for r in ("secret", "id") for name, agg in (("lo", F.min), ("hi", F.max))])
            .withColumnsRenamed({"doc_id": "b_id", "digest": "b_digest", "bin": "b_bin"}))
    weak = found.filter(F.col("kind").isin("account", "short", "endpoint"))
    near = weak.withColumn("look", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    near = near.join(bins, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("digest") == F.col("b_digest"))
                     & (F.col("look") == F.col("b_bin")))

    def close(r: str):
        """A part of the role in this bin starts within the scope."""
        return (F.coalesce(F.abs(F.col(f"{r}_lo") - F.col("start")) <= scope, F.lit(False))
                | F.coalesce(F.abs(F.col(f"{r}_hi") - F.col("start")) <= scope, F.lit(False)))

    ok = (F.when(F.col("kind") == "account", close("secret")).when(F.col("kind") == "short", close("id"))
          .otherwise(close("secret") | close("id")))
    cols = ["doc_id", "digest", "kind", "start", "end"]
    strong = found.filter(F.col("kind").isin("assign", "access", "hex")).select(*cols, F.lit(True).alias("base"))
    return strong.unionByName(near.filter(ok).select(*cols).distinct().withColumn("base", F.lit(False)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; one row per row."""
    spans = linked_spans(docs, id_col, text_col)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct("start", order.alias("order"), F.concat_ws(":", "kind", "start", "end").alias("span"), "base")
    one = lambda k: F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}")
    whole = (spans.groupBy("doc_id", "digest")
             .agg(one("assign"), one("access"), one("hex"), F.array_sort(F.collect_list(item)).alias("all"))
             .select(F.col("doc_id").alias("s_id"), F.col("digest").alias("s_digest"), "n_assign", "n_access", "n_hex",
                     F.array_join(F.transform(F.filter("all", lambda x: x.base), lambda x: x.span), ",").alias("base"),
                     F.array_join(F.transform("all", lambda x: x.span), ",").alias("spans")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text_of(f"`{text_col}`"), 256).alias("digest"))
    out = rows.join(whole, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("digest") == F.col("s_digest")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"),
                      F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                      F.coalesce("spans", F.lit("")).alias("spans"))
