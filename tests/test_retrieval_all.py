"""Searches of many queries, against brute force."""

import duckdb
import numpy as np
import pytest

from kilnlog.operators import retrieval as V
from kilnlog.plans import catalog
from tests.conftest import SMALL


def best(scores, ids, k):
    return [int(ids[i]) for i in np.lexsort((ids, -scores))[:k]]


@pytest.fixture(scope="module")
def small():
    c = duckdb.connect()
    v = c.execute(f"select vec_id, embedding from '{SMALL}/embeddings.parquet'").fetchall()
    items = [r[0] for r in c.execute(f"select item_id from '{SMALL}/benchmark.parquet'").fetchall()]
    return np.array([r[0] for r in v]), np.array([r[1] for r in v], np.float64), items


@pytest.mark.parametrize("name", ["vector_topk", "quant_topk"])
def test_every_hundredth_vector_asks_all_rows(spark, small, name):
    ids, x, _ = small
    got = {}
    for r in catalog.queries()[name](spark, SMALL).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    y = x
    if name == "quant_topk":
        x = V.rotate(x, V.signs(64, 0))
        codes, scale = V.quantise(x, 4)
        y = codes * scale[:, None]
    assert set(got) == {i for i in ids if i % 100 == 0} and len(got) > 1
    for i, found in got.items():
        assert found == best(y @ x[ids == i][0], ids, 10)


def test_blocks_of_queries_and_ties(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_QUERIES", 2)
    rows = [(i, [float(i % 3), 1.0]) for i in range(50)] + [(None, [2.0, 1.0]), (99, None), (98, [None, 1.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("c", [0.0, 1.0]), ("d", None), ("e", [0.0, -1.0])], "query_id string, q array<float>")
    got = {}
    for r in V.vector_top(vectors, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {"a": [None, 2, 5, 8], "b": [0, 3, 6, 9], "c": [None, 0, 1, 2], "e": [None, 0, 1, 2]}
    assert V.vector_top(vectors, asked.where("false"), 4).count() == 0
    assert V.vector_top(vectors.where("false"), asked, 4).count() == 0


@pytest.mark.parametrize("name", ["hybrid_rrf", "tool_kb_search"])
def test_every_item_is_fused(spark, small, name):
    rows = catalog.queries()[name](spark, SMALL).collect()
    assert {r["query_id"] for r in rows} == set(small[2]) and len(small[2]) > 1


def test_the_item_s_own_vector_is_fused(spark, small):
    ids, x, items = small
    docs, asked = catalog._corpus(spark, SMALL)
    lexical = {}
    for r in V.lexical(docs, asked, 20).collect():
        lexical.setdefault(r["query_id"], {})[r["id"]] = r["rank"]
    got = {}
    for r in catalog.hybrid_rrf(spark, SMALL).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"]))
    for i in items:
        near = best(x @ x[ids == i][0], ids, 20) if i in ids else []
        parts = {}
        for j, rank in [*lexical.get(i, {}).items(), *((j, n) for n, j in enumerate(near, 1))]:
            parts[j] = parts.get(j, 0) + 0.5 / (60 + rank)
        want = sorted(parts.values(), reverse=True)[:10]
        assert [s for _, s in sorted(got[i])] == pytest.approx(want, abs=1e-7)


def test_late_words_of_an_item_are_asked(spark, tmp_path):
    late = " ".join(f"early{i}" for i in range(20)) + " rare late passage"
    filler = [(i, f"filler{i} words{i}", "en") for i in range(8)]
    spark.createDataFrame([*filler, (77, "a rare late passage", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, late), (3, "none")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("bm25_topk", "overlap_fallback"):
        assert [(r["query_id"], r["id"]) for r in catalog.queries()[name](spark, str(tmp_path)).collect()] == [(0, 77)]


def test_texts_in_blocks_of_queries(spark, monkeypatch):
    docs, asked = catalog._corpus(spark, SMALL)
    asked = asked.unionByName(spark.createDataFrame([(1000, None), (1001, ""), (1002, "nowhere")], "query_id long, text string"))
    search = lambda: [sorted(map(tuple, f(docs.repartition(3), asked, 4).collect())) for f in (V.bm25, V.overlap)]
    whole = search()
    monkeypatch.setattr(V, "BLOCK_QUERIES", 7)
    for a, b in zip(whole, search(), strict=True):
        assert [(q, i, rank, round(s, 7)) for q, i, s, rank in a] == [(q, i, rank, round(s, 7)) for q, i, s, rank in b] and len(a) > 40
    index = V.bm25_index(docs)
    assert [(q, i, rank) for q, i, _, rank in sorted(map(tuple, V.bm25(docs, asked, 4, index=index).collect()))] == [(q, i, rank) for q, i, _, rank in whole[0]]
    none = docs.where("false")
    assert V.bm25(none, asked, 4).count() == V.overlap(none, asked, 4).count() == V.bm25(docs, asked.where("false"), 4).count() == 0
