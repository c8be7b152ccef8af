"""Rows that every text operator must bear: nulls, empty and long texts, repeats, ties, columns with clashing names."""

from __future__ import annotations

LONG = "word " * 60_000 + "x" * 5_000
ROWS = [
    (1, "Plain words of a small document, nothing else.\nA second line of it.", "en", "src1", 60),
    (2, None, "en", "src1", None),
    (3, "", "fr", None, 0),
    (4, LONG, None, "src2", len(LONG)),
    (5, "Naïve café – 日本語 <|endoftext|> 🇩🇪\x00\t\r\n\u0085 end", "de", "src2", 10),
    (6, "Plain words of a small document, nothing else.\nA second line of it.", "en", "src3", 60),
    (6, "Plain words of a small document, nothing else.\nA second line of it.", "en", "src3", 60),
    (7, "   \n\n ,.;", "es", "", 9),
    (None, "a document without an id", "en", "src1", 24),
    (9, "one", "en", "src1", 3),
    (9, "another text under the same id", "en", "src1", 30),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "size", "key", "ids", "spans", "text_key", "copies", "target", "rid", "n", "hits", "value", "_key", "_d", "_n", "_k", "_live", "_place", "_copies", "_i", "_row", "found", "spans_", "secret_row", "secret_live", "mix_row", "MIX_PLACE", "mix_copies", "mix_i", "dedup_id", "Dedup_Key", "dedup_n", "_toxicity0", "c_text", "owner", "repo", "keep0", "tie")


def documents(spark, rows=ROWS, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    odd = {"a.b": F.lit("own a.b"), "a`c": F.lit("own"), "by name": F.create_map(F.lit("k"), F.struct(F.lit(1).alias("n"))), "parts": F.struct(F.lit(1).alias("x.y"), F.array(F.create_map(F.lit(1), F.lit(2))).alias("z"))}
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES} | odd) if clash else df


def empty(spark):
    return documents(spark, [])


def keeps_values(out) -> None:
    """Columns with names that operators use themselves come out as they went in."""
    for r in out.collect():
        assert all(r[c] == f"own {c}" for c in (*CLASHES, "a.b")), r
        assert r["by name"]["k"].n == 1 and r["parts"][0] == 1 and r["parts"].z == [{1: 2}], r
