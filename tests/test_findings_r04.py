"""What the findings of round 4 asked for."""

from __future__ import annotations

import itertools
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from textloom.llm import tokens
from textloom.operators import late_interaction, models
from textloom.plans import model_queries
from textloom.sources import stored


def _cancelling(dims):
    """Two words of one dimension and opposite signs."""
    seen = {}
    for w in map("".join, itertools.product("abcdefgh", repeat=4)):
        h = zlib.crc32(w.encode())
        if (other := seen.setdefault((h % dims, 1 - (h >> 31)), None)) is not None:
            return w, other
        seen[h % dims, h >> 31] = w
    raise AssertionError


@pytest.mark.parametrize("lang", ["en", "de", None])
def test_every_text_of_the_cache_has_a_vector_of_unit_length(spark, tmp_path, lang):
    odd = [None, "", " \n\t", " ".join(_cancelling(256)), "\u3000", "beam", "Beam", None, ""]
    rows = [(i, t, lang or ("en", "de")[i % 2]) for i, t in enumerate(odd)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = model_queries.embed_cache(spark, str(tmp_path)).select("content_key", "dims", "norm").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(model_queries.ORACLES["embed_cache"]).fetchall(), key=repr)


def test_words_that_cancel_keep_their_dimension():
    a, b = _cancelling(16)
    texts = [f"{a} {b}", f"{a} {b} {b}", "", None, f"{a} {b} {b} {a}"]
    for always in (False, True):
        got = np.array(models.hashing_embedder(16, always)(pd.Series(texts)))
        assert np.flatnonzero(got[0]).tolist() == [zlib.crc32(a.encode()) % 16] and got[0].max() == 1 and (got[4] == got[0]).all()
        assert np.linalg.norm(got, axis=1).tolist() == [1, 1, always, always, 1]


@pytest.mark.parametrize("spread, passes", [(5, 4), (0, 6)])  # with no spread the samples' ranges miss many
def test_tokens_meet_in_two_passes_and_those_of_samples(spark, spread, passes, monkeypatch):
    for name, value in {"QUERY_TILE": 8, "COUNT_TILE": 30, "COUNTS": 500, "DIRECT": 40, "SAMPLE": 90, "SAMPLE_DOCS": 30, "SPREAD": spread}.items():
        monkeypatch.setattr(late_interaction, name, value, raising=False)
    rng = np.random.default_rng(7)
    docs = {i * 7 - 30: rng.normal(size=(rng.integers(1, 7), 4)) for i in range(160)}
    docs |= {2000 + i: docs[-30] for i in range(3)} | {3000: rng.normal(size=(50, 4))}  # copies tie
    asks = {i: rng.normal(size=(rng.integers(1, 6), 4)) for i in range(20)}
    table = lambda sets, names: spark.createDataFrame([(i, p, v.tolist()) for i, m in sets.items() for p, v in enumerate(m)], names)
    index = late_interaction.TokenIndex.build(table(docs, "doc_id long, place long, v array<double>"), stored.new_path(spark, "tokens"), lists=6)
    _, unit = late_interaction.IvfIndex(spark, f"{index.path}/index").centroids()
    normal = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    lists = {i: (normal(m) @ unit.T).argmax(axis=1) for i, m in docs.items()}
    best = set()
    for q, a in asks.items():
        near_lists = np.argsort(-(normal(a) @ unit.T), axis=1, kind="stable")[:, :4]
        cos = {i: normal(a) @ normal(m).T for i, m in docs.items()}
        met = {i: np.stack([np.isin(lists[i], near) for near in near_lists]) for i in docs}
        keys = {i: np.where(met[i], np.rint(cos[i] * 1e6), -9e6) for i in docs}
        floor = np.sort(np.concatenate(list(keys.values()), axis=1), axis=1)[:, ::-1][:, 59]
        over = {i: (k - floor[:, None]).max(axis=1) for i, k in keys.items()}
        near = sorted((-np.maximum(g, 0).sum(), i) for i, g in over.items() if (g >= 0).any())[:40]
        scores = sorted((-round(float(cos[i].max(axis=1).sum()), 6), i) for _, i in near)
        best |= {(q, i, -s, r) for r, (s, i) in enumerate(scores[:5], 1)}
    made, apply = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda *args: (made.append(1), apply(*args))[1])
    found = index.search(table(asks, "query_id long, place long, q array<double>"), 5, probes=4, nearest=60, depth=40).collect()
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found} == best
    assert len(made) == passes


def test_documents_of_a_chunk_get_their_largest_values(monkeypatch):
    monkeypatch.setattr(late_interaction, "CHUNK", 16, raising=False)
    monkeypatch.setattr(late_interaction, "SHORT", 3, raising=False)
    rng = np.random.default_rng(9)
    sizes = dict(zip(rng.permutation(40).tolist(), [*rng.integers(1, 9, 38).tolist(), 20, 17]))
    rows = [(d, 100 + d, rng.integers(5), rng.normal(size=3).tolist()) for d, n in sizes.items() for _ in range(n)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held = late_interaction._Documents(pa.table(list(map(list, zip(*rows))), ["doc_id", "at", "list", "v"]))
    seen = {}
    assert len(held.chunks) > 8
    for docs, tokens, lists, parts, short in held.chunks:
        best = held.best(np.column_stack((tokens, lists)), parts, short)
        seen |= {int(held.ids[d]): row.tolist() for d, row in zip(docs, best)}
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    assert seen == {d: pytest.approx(np.max([[*unit(v), n] for i, _, n, v in rows if i == d], axis=0).tolist()) for d in sizes}
    assert held.at.tolist() == [100 + d for d in held.ids.tolist()]


def test_special_tokens_in_capitals_are_plain_text():
    encoder = tokens.WordBpe(tokens.tokenizer_path(tokens.WORD_BPE))
    for mark in encoder.marks:
        for texts in ([mark.upper()], [f"a {mark.title()}b", "plain"], [f"{mark.upper()} {mark}"], ["plain"]):
            ids, starts = encoder.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
