"""The pipeline's rows against a brute-force version over the smallest tables, and the queries against their SQL."""

import hashlib
import os
import re
import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillon.llm import minhash, queries  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, same  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    kept = {r.doc_id for r in corpus_pipeline.by_quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    rows = [d for d in docs if d.doc_id in kept]
    groups = {}
    for d in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", d.text or ""), []).append(d)
    rows = sorted((max(g, key=lambda d: (len(d.text or ""), -d.doc_id)) for g in groups.values()), key=lambda d: d.doc_id)
    sets = [minhash._set(d.text, 5) for d in rows]
    up = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((up[a], up[b]))
                up = [low if x == high else x for x in up]
    rows = [d for i, d in enumerate(rows) if up[i] == i]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    clean = []
    for d in rows:
        w = words(d.text)
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.append(d)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {d.doc_id for d in clean}
    assert all(got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest() for d in clean)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_columns_and_bear_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    docs = docs.unionAll(docs).unionAll(spark.sql("select cast(null as long), cast(null as string), cast(null as string), cast(null as string), cast(null as long)"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.by_copies(spark, docs, SF).count() == len({r.text for r in docs.collect()})


@pytest.mark.parametrize("name", queries.SQL)
def test_query_against_sql(spark, name):
    assert same(spark, connect(SF), name, queries.QUERIES[name], queries.SQL[name], SF) is None
