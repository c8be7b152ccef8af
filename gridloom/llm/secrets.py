"""Secret scan with corpus-wide ownership frequency.

Detectors give spans (code points, end exclusive). Each candidate value is hashed; the corpus is aggregated by
hash to its distinct repositories and owners. A value of `min_owners` owners, or of two owners and `min_repos`
repositories, is a copied example; any other value that looks random is a live credential of its owner, however often that
owner repeats it.

Cases: a null text is empty, a null owner or repository counts as one of its own kind; texts without secrets
give zeros and the digest of the empty string; repeated rows are scanned one by one and count as one repository;
other columns pass redact() untouched.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_OWNERS, MIN_REPOS, MIN_ENTROPY = 3, 20, 2.5

BASE_KINDS = {
    "assign": (r"""(?ia:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
"""Kind: pattern, the group whose length counts, its least length."""

MORE_KINDS = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 34, "gh"),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 14, "xox"),
    "google": (r"AIza[0-9A-Za-z_-]{35}", 0, 39, "AIza"),
    "stripe": (r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 24, "k_"),
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 28, "eyJ"),
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*+[A-Za-z-]++: (?:(?!-----)[^\r\n])++)*+[A-Za-z0-9+/=\s]++-----END [A-Z ]*PRIVATE KEY-----", 0, 40, "PRIVATE KEY"),
    "url": (r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]{3,}+@", 0, 12, "://"),
}
"""The same with a substring that a text must have. Runs are possessive: no length is bounded and none is walked twice."""

KINDS = [*BASE_KINDS, *MORE_KINDS]
KEYWORD = re.compile(r"(?ia:password|passwd|secret|token|api_?key)")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value_hash", T.StringType()), T.StructField("entropy", T.DoubleType())])


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def spans_of(text: str):
    """(kind, start, end, value) by start, then kind as listed."""
    out = []
    for kind, (pattern, group, least) in BASE_COMPILED.items():
        if kind == "access" and "AKIA" not in text or kind == "assign" and not KEYWORD.search(text):
            continue
        out += [(m.start(), kind, m.end(), m[group]) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    for kind, (pattern, group, least, must) in MORE_COMPILED.items():
        if must in text:
            out += [(m.start(), kind, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    out.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return [(kind, a, b, value) for a, kind, b, value in out]


# A run of hex digits is long enough or fails as a whole: the possessive form only skips short ones faster.
BASE_COMPILED = {k: (re.compile(p if k != "hex" else r"(?<![0-9a-f])[0-9a-f]{16,}"), g, n) for k, (p, g, n) in BASE_KINDS.items()}
MORE_COMPILED = {k: (re.compile(p), g, n, m) for k, (p, g, n, m) in MORE_KINDS.items()}


def candidates(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` and `found`: array of candidate spans with the hash of the value, never the value."""

    def make():
        def run(texts):
            return [
                [
                    [dict(kind=k, start=a, end=b, value_hash=hashlib.sha256(v.encode()).hexdigest(), entropy=entropy(v)) for k, a, b, v in spans_of(t or "")]
                    for t in texts
                ]
            ]

        return run

    return common.scan(df, keep, [text], [T.StructField("found", T.ArrayType(SPAN))], make)


def ownership(found: DataFrame, owner: str, repo: str, min_owners: int, min_repos: int) -> DataFrame:
    """Per candidate hash: distinct owners and repositories over the corpus, and whether it is a copied example.

    Two levels of partial aggregation (hash and owner or repository, then hash): a hash in a third of all rows
    reaches one task only as one row per distinct owner or map task.
    """
    per = found.select(F.explode("found").alias("s"), F.col(owner).alias("o"), F.col(repo).alias("r")).select("s.value_hash", "o", "r")
    none = F.lit("\x00null")
    each = lambda c: F.coalesce(F.col(c).cast("string"), none)
    kinds = per.select("value_hash", F.explode(F.array(F.struct(F.lit("o").alias("k"), each("o").alias("v")), F.struct(F.lit("r").alias("k"), each("r").alias("v")))).alias("x"))
    distinct = kinds.groupBy("value_hash", "x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    n = lambda k: F.sum(F.when(F.col("k") == k, 1).otherwise(0)).cast("long")
    agg = distinct.groupBy("value_hash").agg(n("o").alias("n_owners"), n("r").alias("n_repos"), F.sum(F.when(F.col("k") == "o", F.col("n"))).alias("n_found"))
    return agg.withColumn("copied", (F.col("n_owners") >= min_owners) | (F.col("n_owners") >= 2) & (F.col("n_repos") >= min_repos))


def scan_secrets(
    df: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", keep: list[str] | None = None,
    min_owners: int = MIN_OWNERS, min_repos: int = MIN_REPOS, min_entropy: float = MIN_ENTROPY,
) -> DataFrame:
    """Columns `keep` and `spans`: array of (start, place of the kind, kind, end, n_owners, n_repos, verdict), sorted.

    verdict is example, live or weak. Candidates are scanned once and kept, without texts, in the shared folder.
    """
    keep = keep or ["doc_id"]
    named = {f"keep{i}": common.quoted(c) for i, c in enumerate(keep)}
    base = df.select(*(c.alias(n) for n, c in named.items()), F.col(owner).alias("owner"), F.col(repo).alias("repo"), F.col(text).alias("text"))
    found = common.save(candidates(base, "text", [*named, "owner", "repo"]).withColumn("_row", F.monotonically_increasing_id()), "secrets-found")
    hashes = common.save(ownership(found, "owner", "repo", min_owners, min_repos), "secrets-owners")
    total = hashes.agg(F.sum("n_found")).first()[0] or 0
    each = found.filter(F.size("found") > 0).select("_row", F.explode("found").alias("s")).select("_row", "s.*")
    judged = common.join_hot(each, hashes, "value_hash", "n_found", total)
    verdict = F.when(F.col("copied"), "example").when((F.col("kind") != "hex") & (F.col("entropy") >= min_entropy), "live").when(F.col("entropy") >= min_entropy + 0.5, "live").otherwise("weak")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("place"), "kind", "end", "n_owners", "n_repos", verdict.alias("verdict"))
    per_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    empty = F.expr("CAST(array() AS array<struct<start: bigint, place: bigint, kind: string, end: bigint, n_owners: bigint, n_repos: bigint, verdict: string>>)")
    return found.drop("found").join(per_row, "_row", "left").select(*(F.col(n).alias(c) for n, c in zip(named, keep, strict=True)), F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, with live credentials in `text` masked; copied examples stay.

    A row's own candidate hashes are compared with those of live credentials, so the text never shuffles: rows
    with candidates meet their verdict by a row hash of (repo, text).
    """
    key, live = common.free(docs.columns, "secret_row", "secret_live")
    of = F.sha2(F.concat_ws("\x1f", F.coalesce(F.col(repo).cast("string"), F.lit("\x00")), F.coalesce(F.col(text), F.lit(""))), 256)
    keyed = docs.withColumn(key, of)
    judged = scan_secrets(keyed, text, owner, repo, [key])
    cuts = judged.select(key, F.transform(F.filter("spans", lambda s: s["verdict"] == "live"), lambda s: F.struct(s["start"], s["end"])).alias(live)).filter(F.size(live) > 0)
    cuts = cuts.groupBy(key).agg(F.first(live).alias(live))

    def cut(live_spans, t):
        merged, last = [], 0
        for a, b in sorted((s["start"], s["end"]) for s in live_spans):
            if a < last:
                a = last
            if b > a:
                merged += [t[last:a], mask]
                last = b
        return "".join([*merged, t[last:]])

    def make():
        return lambda spans, texts: [[cut(s, t) if s else t for s, t in zip(spans, texts, strict=True)]]

    both = keyed.join(cuts, key, "left")
    out = common.scan(both, [c for c in docs.columns if c != text], [live, text], [T.StructField(text, T.StringType())], make)
    return out.select(*common.same(docs))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(common.table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    n = lambda k: F.size(of(k)).cast("long").alias(f"n_{k}")
    count = lambda v: F.size(F.filter("spans", lambda s: s["verdict"] == v)).cast("long")
    return rows.select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count("live").alias("n_live"), count("example").alias("n_example"),
    )
