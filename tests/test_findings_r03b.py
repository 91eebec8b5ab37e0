"""What the findings of round 3 that were open after its first fixes asked for."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from textloom.operators import documents, late_interaction, vector_index
from textloom.sources import stored
from textloom.streaming import stateful


@pytest.mark.parametrize("nearest, depth", [(15, 5), (15, None)])
def test_candidates_come_from_counts(spark, nearest, depth, monkeypatch):
    for name, value in (("QUERY_TILE", 8), ("DOC_TILE", 20), ("COUNT_TILE", 16), ("COUNTS", 5000)):
        monkeypatch.setattr(late_interaction, name, value)
    rng = np.random.default_rng(6)
    docs = {i * 7 - 30: rng.normal(size=(rng.integers(1, 7), 4)) for i in range(25)}
    docs |= {500 + i: docs[-30] for i in range(3)}  # copies tie
    asks = {i: rng.normal(size=(rng.integers(1, 5), 4)) for i in range(9)}
    table = lambda sets, names: spark.createDataFrame([(i, p, v.tolist()) for i, m in sets.items() for p, v in enumerate(m)], names)
    index = late_interaction.TokenIndex.build(table(docs, "doc_id long, place long, v array<double>"), stored.new_path(spark, "tokens"), lists=3)
    monkeypatch.setattr(vector_index.IvfIndex, "search", lambda *_, **__: pytest.fail("a row for each token and near token"))
    queries = table(asks, "query_id long, place long, q array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    chosen, best = set(), set()
    for q, a in asks.items():
        cos = {i: unit(a) @ unit(m).T for i, m in docs.items()}
        every = np.sort(np.concatenate([np.rint(c * 1e6) for c in cos.values()], axis=1), axis=1)[:, ::-1]
        floor = every[:, min(nearest, every.shape[1]) - 1]
        over = {i: (np.rint(c * 1e6) - floor[:, None]).max(axis=1) for i, c in cos.items()}
        near = sorted((-np.maximum(g, 0).sum(), i) for i, g in over.items() if (g >= 0).any())[:depth]
        chosen |= {(q, i) for _, i in near}
        scores = sorted((-round(float(cos[i].max(axis=1).sum()), 6), i) for _, i in near)
        best |= {(q, i, -s, r) for r, (s, i) in enumerate(scores[:4], 1)}
    assert {tuple(r) for r in index.candidates(queries, None, nearest, depth).collect()} == chosen
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in index.search(queries, 4, nearest=nearest, depth=depth).collect()} == best


class _State(dict):
    """Keyed state in memory, and how many calls it took."""

    calls, timers = 0, ()

    def getValueState(self, name, *schema):
        return self

    getMapState = getListState = getValueState

    def _call(self, key=None, value=None, drop=False):
        self.calls += 1
        if value is not None:
            self[key] = value
        return self.pop(key, None) if drop else super().get(key)

    get, update, clear = (lambda self: self._call()), (lambda self, v: self._call(None, v)), (lambda self: self._call(drop=True))
    getValue, updateValue, removeKey = _call, _call, lambda self, k: self._call(k, drop=True)

    def registerTimer(self, at):
        self.calls += 1
        self.timers = (*self.timers, at)


def _rows(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"us": rng.integers(0, n, n) * 700, "event_id": rng.permutation(n), "value": np.where(rng.random(n) < 0.1, np.nan, rng.integers(1, 99, n)), "failed": rng.random(n) < 0.3})


def test_state_of_a_key_is_merged_in_slices():
    rows, state, health = _rows(50_000, 1), _State(), stateful.RollingHealth(7)
    health.init(state)
    assert list(health.handleInputRows(("a",), (rows[i : i + 5000] for i in range(0, 50_000, 5000)), None)) == []
    assert all(len(v[0]) <= stateful.RUN * 25 for k, v in state.items() if k is not None) and len(state) > 90
    end = TimerValues(0, 20_000), TimerValues(0, 10**9)
    slices = [f for now in end for f in health.handleExpiredTimer(("a",), now, None)]
    assert max(map(len, slices)) <= stateful.SLICE and len(slices) >= 5 and list(state) == [None] and len(state[None][1]) == 0
    got, want = pd.concat(slices), rows.sort_values(["us", "event_id"])
    assert got["event_id"].tolist() == want["event_id"].tolist()
    p95 = [np.nanpercentile(w, 95) if (w := want["value"].to_numpy()[max(0, i - 6) : i + 1]).size > np.isnan(w).sum() else np.nan for i in range(0, 50_000, 37)]
    np.testing.assert_allclose(got["p95_ms"].to_numpy()[::37], p95)
    np.testing.assert_allclose(got["error_pct"], 100 * want["failed"].astype(float).rolling(7, min_periods=1).mean())


def test_state_of_a_key_with_few_rows_takes_few_calls():
    state, lookups = _State(), stateful.Renewed(1000)
    lookups.init(state)
    list(lookups.handleInputRows(("a",), iter([_rows(20, 2)]), None))
    found = list(lookups.handleExpiredTimer(("a",), TimerValues(0, 10**9), None))
    assert len(found) == 1 and not state and state.calls <= 5


def test_entities_are_looked_for_without_lambdas(spark):
    texts = ["METAL apple, AMD and google.", "pineapple", "", None, "İBM ibm 5g New York Sam Altman Amd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = rows.select("id", *(c.alias(k) for k, c in documents.dictionary_entities(F.col("text")).items()))
    got = {r["id"]: (r["companies"], r["technologies"], r["people"], r["locations"]) for r in found.collect()}
    assert got[0] == (["AMD", "Apple", "Google"], [], [], []) and got[1] == got[2] == got[3] == ([], [], [], [])
    assert got[4][0] == ["AMD", "IBM"] and got[4][1] == ["5G"] and got[4][2:] == (["Sam Altman"], ["New York"])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
