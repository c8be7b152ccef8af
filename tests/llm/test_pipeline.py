from __future__ import annotations

import hashlib
import struct

import pytest

import corpus_pipeline
from gridloom.llm import bpe, registry

from ..conftest import SMALL
from .common_rows import ROWS, documents


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    base = tmp_path_factory.mktemp("pipeline")
    docs, seen = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{base}/{name}")
        out = spark.read.parquet(f"{base}/{name}")
        seen.append((name, docs, out))
        docs = out
    return seen


def test_stages_are_named_in_order_and_keep_columns(stages):
    assert [n for n, *_ in stages] == ["toxicity", "near_dedup", "secrets", "mixing", "bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_filters_only_remove_and_secrets_keep_rows(stages):
    for _name, before, after in stages[:2]:
        assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()
    _, before, after = stages[2]
    assert sorted(r.doc_id for r in before.collect()) == sorted(r.doc_id for r in after.collect())
    assert after.filter("n_chars <> length(text)").isEmpty()


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    _, before, after = stages[0]
    clean = before.join(labels.filter("toxic = 0"), "doc_id", "left_semi")
    gone = clean.join(after, "doc_id", "left_anti").count()
    assert gone <= 0.03 * clean.count()


def test_mixing_repeats_whole_documents(stages):
    _, before, after = stages[3]
    count = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert max(count.values()) <= 3 and after.distinct().exceptAll(before).isEmpty()


def test_bpe_equals_the_library(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.tokenizer_path())
    _, before, after = stages[4]
    text = {r.doc_id: r.text for r in before.collect()}
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids))) == lib.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_rows_of_the_stages(spark, stages):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(stages[-1][2])


def test_pipeline_bears_edge_rows_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int")
    for name, rows in (("rows", ROWS), ("none", [])):
        documents(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.filter("1 = 1" if rows else "1 = 0").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert bool(out) == bool(rows)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle_sql_gives_the_same_rows(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    want = c.execute(registry.ORACLE_SQL[name]).df()[list(got.columns)]
    order = list(got.columns[:2])
    a, b = (x.sort_values(order).reset_index(drop=True).astype(object).where(lambda v: v.notna(), None) for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a.itertuples(index=False), b.itertuples(index=False), strict=True):
        assert all(p == q or (isinstance(p, float) and abs(p - q) < 1e-9) for p, q in zip(x, y, strict=True)), (x, y)
