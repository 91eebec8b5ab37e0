"""Places for models: embedders, generators and rerankers, with defaults that need none.

A model is a function of a pandas Series; it runs inside vectorised UDFs, so
a neural one can be put in without touching the plans around it.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.stored import stored
from . import lexical
from . import vectors as search
from .keyed_store import KeyedStore
from .parallel import SLICE, spread

Embedder = Callable[[pd.Series], list[list[float] | None]]


def hashing_embedder(dims: int = 256, always: bool = False) -> Embedder:
    """A stand-in for a model: signed feature hashing of lower-case words, unit length; empty texts give zeros.

    Words whose signs leave nothing count without them. With `always` a text
    without words gets the first unit vector, as a model gives one to any text.
    A slice's distinct words are hashed once each.
    """

    def embed(texts: pd.Series) -> list[list[float]]:
        return [v for i in range(0, len(texts), SLICE) for v in part(texts.iloc[i : i + SLICE])]

    def part(texts: pd.Series) -> list[list[float]]:
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string()), "")))
        coded = words.flatten().dictionary_encode()
        hashed = np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.int64)
        index = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
        real = np.array([bool(w) for w in coded.dictionary.to_pylist()], bool)[index] if len(hashed) else np.empty(0, bool)
        h = hashed[index[real]] if len(hashed) else np.empty(0, np.int64)
        sums = np.bincount(row[real] * dims + h % dims, np.where(h >> 31, 1.0, -1.0), len(texts) * dims)
        out = sums.reshape(len(texts), dims).astype(np.float32)
        left = ~out.any(axis=1)
        if left.any():
            lost = left[row[real]]
            out[left] = np.bincount(row[real][lost] * dims + h[lost] % dims, minlength=len(texts) * dims).reshape(len(texts), dims)[left]
            if always:
                out[~out.any(axis=1), 0] = 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def embed(rows: DataFrame, text: str, out: str = "vector", embedder: Embedder | None = None, dims: int | None = None) -> DataFrame:
    """Add a vector; `dims` keeps the first dimensions and normalises again."""
    run = embedder or hashing_embedder()
    column = F.pandas_udf(lambda s: pd.Series(run(s)), "array<float>")(F.col(text))
    return rows.withColumn(out, column if dims is None else V.truncate(column, dims))


def embed_missing(rows: DataFrame, cache: DataFrame, text: str, embedder: Embedder | None = None) -> DataFrame:
    """content_key, vector of each distinct text: from the cache where it has the key, else embedded once.

    A null text has the null key, in the cache too, and is embedded as an empty one.
    """
    keyed = spread(rows).select(F.sha2(F.col(text), 256).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    same = F.col("content_key").eqNullSafe(F.col("_key"))
    fresh = keyed.join(cache, same, "left_anti").groupBy(F.col("_key").alias("content_key")).agg(F.first("_text").alias("_text"))
    known = cache.join(keyed.select("_key").distinct(), same, "left_semi").select("content_key", "vector")
    return known.unionByName(embed(fresh, "_text", embedder=embedder).select("content_key", "vector"))


def embedded_batches(rows: DataFrame, done: DataFrame, text: str, key: str, attempts: int = 3, embedder: Embedder | None = None, backoff: float = 0.0) -> DataFrame:
    """key, vector, attempts (of the batch), failed: rows whose key `done` lacks are embedded, each batch tried up to `attempts` times, then row by row.

    Before a try after the first the task waits `backoff` seconds, doubled each
    time. A batch that fails for good is embedded a row at a time, so that one
    bad text doesn't cost the others their vectors; a row that fails then is
    marked, not raised, and is taken up again by the next run, as `done` holds
    the keys that have a vector.
    """
    run = embedder or hashing_embedder()

    def tried(texts: pd.Series, most: int) -> tuple[list | None, int]:
        for n in range(1, most + 1):
            if n > 1 and backoff:
                time.sleep(backoff * 2 ** (n - 2))
            try:
                return list(run(texts)), n
            except Exception:  # a model may fail in any way
                continue
        return None, most

    def batches(frames):
        for pdf in frames:
            vectors, tries = tried(pdf["_text"], attempts)
            failed = [False] * len(pdf)
            if vectors is None:
                alone = [tried(pdf["_text"].iloc[i : i + 1], 1)[0] for i in range(len(pdf))]
                vectors, failed = [a[0] if a else None for a in alone], [a is None for a in alone]
            yield pd.DataFrame({"key": pdf["key"], "vector": vectors, "attempts": tries, "failed": failed})

    todo = spread(rows).join(done.select(F.col("key").alias(key)), key, "left_anti").select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return todo.mapInPandas(batches, "key string, vector array<float>, attempts int, failed boolean")


#: Filters of an analysed query, the column of the documents each is about, and how they compare.
FILTERS = {"document_id": ("document_id", "eq"), "has_equations": ("has_equations", "eq"), "has_figures": ("has_figures", "eq"), "page_gte": ("page_number", "ge"), "page_lte": ("page_number", "le")}


def merged_filters(queries: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """query_id, expanded_query, alpha and the filters of each query: what its text names, or what `given` (query_id, some of FILTERS) has instead; null where neither says anything."""
    found = lexical.analyze(queries, "query")
    named = {f: F.when(F.col(f), True) if how == "eq" and f.startswith("has_") else F.col(f) for f, (_, how) in FILTERS.items()}
    out = found.select("query_id", "expanded_query", "alpha", *(c.alias(f) for f, c in named.items()))
    if given is not None:
        own = [f for f in FILTERS if f in given.columns]
        more = given.select("query_id", *(F.col(f).alias(f"_{f}") for f in own))
        out = out.join(more, "query_id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in own}).drop(*(f"_{f}" for f in own))
    return out


def _passes(used: list[str]) -> Column:
    """Whether a row with filters and the columns they are about passes all filters that are set."""
    tests = {"eq": lambda c, v: c == v, "ge": lambda c, v: c >= v, "le": lambda c, v: c <= v}
    return reduce(lambda a, b: a & b, (F.col(f).isNull() | F.coalesce(tests[FILTERS[f][1]](F.col("_" + FILTERS[f][0]), F.col(f)), F.lit(False)) for f in used), F.lit(True))


def _kept(used: list[str]) -> search.Keep:
    """The same over groups of queries and documents, as a matrix."""
    tests = {"eq": np.equal, "ge": np.greater_equal, "le": np.less_equal}

    def keep(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        out = np.ones((len(a), len(b)), bool)
        for f in used:
            column, how = FILTERS[f]
            for i in np.flatnonzero(a[f].notna().to_numpy()):
                value, held = a[f].iloc[i], b["_" + column]
                known = held.notna().to_numpy()
                out[i, ~known] = False
                out[i, known] &= tests[how](held[known].to_numpy(), value).astype(bool)
        return out

    return keep


def semantic_search(queries: DataFrame, docs: DataFrame, k: int = 10, embedder: Embedder | None = None, given: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: each query's k nearest documents by vectors of its expanded text, among those that pass the filters it names or is given (see `merged_filters`)."""
    used = [f for f, (column, _) in FILTERS.items() if column in docs.columns]
    about = [F.col(c).alias("_" + c) for c in dict.fromkeys(FILTERS[f][0] for f in used)]
    asked = stored(embed(merged_filters(queries, given), "expanded_query", "q", embedder).select("query_id", "q", *used), "asked")
    texts = stored(embed(spread(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text", *about)), "text", "v", embedder).drop("text"), "embedded-texts")
    found = search.batch_top_k(asked, texts, k, own=True, keep=_kept(used) if used else None)
    return found.withColumnRenamed("id", "doc_id")


def two_stage(queries: DataFrame, docs: DataFrame, k: int = 10, depth: int = 100, embedder: Embedder | None = None, given: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: BM25's and the vectors' best `depth` of the documents that pass a query's filters, fused by the query's weight, the best `depth` of them reranked by cosine.

    `queries` is (query_id, query). Analysis gives each query its weight of
    lexical search, an expansion that the vectors' side looks for, and filters,
    of which those of `given` count before the ones found in the text. Filters
    about columns that the documents don't have are not applied. Every text is
    embedded once, into a table of the shared folder.
    """
    used = [f for f, (column, _) in FILTERS.items() if column in docs.columns]
    about = [F.col(c).alias("_" + c) for c in dict.fromkeys(FILTERS[f][0] for f in used)]
    asked = merged_filters(queries, given).join(queries.select("query_id", "query"), "query_id")
    asked = stored(embed(embed(asked, "expanded_query", "eq", embedder), "query", "q", embedder).select("query_id", "alpha", "q", "eq", *used), "asked")
    texts = stored(embed(spread(docs.where("doc_id IS NOT NULL").select("doc_id", "text", *about)), "text", "v", embedder).drop("text"), "embedded-texts")
    near = search.batch_top_k(asked.select("query_id", F.col("eq").alias("q"), *used), texts.withColumnRenamed("doc_id", "id"), depth, own=True, keep=_kept(used) if used else None).withColumnRenamed("id", "doc_id")
    found = lexical.bm25(queries, docs, None if used else depth)
    if used:
        found = found.join(texts.drop("v"), "doc_id").join(asked.select("query_id", *used), "query_id").where(_passes(used)).select("query_id", "doc_id", "score")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= depth)
    both = lexical.rrf(near, found, weights=asked.select("query_id", (1 - F.col("alpha")).alias("semantic_weight")), top=depth)
    candidates = both.select("query_id", "doc_id").join(texts.select("doc_id", "v"), "doc_id").join(asked.select("query_id", "q"), "query_id")
    return rerank(candidates, k)


def rerank(candidates: DataFrame, k: int, query_vector: str = "q", vector: str = "v") -> DataFrame:
    """Candidates (query_id, doc_id, q, v) by cosine: rank 1..k, ties to the smaller id."""
    scored = candidates.withColumn("score", F.round(V.cosine(F.col(query_vector), F.col(vector)), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def rerank_texts(candidates: DataFrame, k: int, embedder: Embedder | None = None) -> DataFrame:
    """Candidates (query_id, query, doc_id, text) by the cosine of their pooled text vectors; equal queries and texts are embedded once."""
    sides = {}
    for name in ("query", "text"):
        one = spread(candidates.select(F.coalesce(name, F.lit("")).alias(name))).distinct()
        sides[name] = embed(one, name, name[0] + "v", embedder)
    rows = candidates.select("query_id", "doc_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce("text", F.lit("")).alias("text"))
    return rerank(rows.join(sides["query"], "query").join(sides["text"], "text"), k, "qv", "tv")


def cache_key(query: Column, ids: Column) -> Column:
    """The key of a query with a list of candidates, whatever the order of these."""
    return F.sha2(F.concat(F.lit("reranking:"), F.coalesce(query, F.lit("")), F.lit(":"), F.array_join(F.array_sort(ids.cast("array<string>")), ",")), 256)


def rerank_cached(candidates: DataFrame, cache: KeyedStore, k: int, now: int) -> DataFrame:
    """`rerank` of candidates (query_id, query, doc_id, q, v), from a store where it has a query with the same candidates; what it hasn't is reranked and put there.

    Gives query_id, doc_id, score, rank and whether they came from the store.
    The store's rows are (cache_key, used, doc_ids, scores); `now`, the version
    of what is written, orders writes of the same key. A list of candidates is
    as long as the search before was deep, so it fits a row.
    """
    lists = candidates.groupBy("query_id").agg(F.first("query").alias("query"), F.collect_list("doc_id").alias("ids"))
    keyed = stored(lists.select("query_id", cache_key(F.col("query"), F.col("ids")).alias("cache_key")), "rerank-keys")
    hits = stored(keyed.join(cache.get(keyed.select("cache_key")), "cache_key").select("query_id", "doc_ids", "scores"), "rerank-hits")
    missed = keyed.join(hits.select("query_id"), "query_id", "left_anti")
    fresh = stored(rerank(candidates.join(missed.select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "q", "v"), k), "reranked")
    rows = fresh.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r")).join(missed, "query_id")
    cache.upsert(rows.groupBy("cache_key").agg(F.lit(now).cast("long").alias("used"), F.first("r.doc_id").alias("doc_ids"), F.first("r.score").alias("scores")))
    back = hits.select("query_id", F.posexplode(F.arrays_zip("doc_ids", "scores")).alias("rank", "r")).where(F.col("rank") < k)
    return fresh.withColumn("cached", F.lit(False)).unionByName(back.select("query_id", F.col("r.doc_ids").alias("doc_id"), F.col("r.scores").alias("score"), (F.col("rank") + 1).alias("rank"), F.lit(True).alias("cached")))


#: Schema of the store of reranked lists.
RERANKED = "cache_key string, used long, doc_ids array<long>, scores array<double>"

Generator = Callable[[pd.Series], list[str | None]]


def generate(prompts: DataFrame, generators: dict[str, Generator], attempts: int = 3, key: str = "query_id", prompt: str = "prompt") -> DataFrame:
    """key, answer, provider, attempts, success: each batch of prompts goes to the first generator, up to `attempts` times, then to the next.

    An answer of null is a prompt that the generator refused; it goes on to the
    next one alone. A prompt that none answers has success = false and no answer.
    """

    def run(frames):
        for pdf in frames:
            answers, providers, tries = [None] * len(pdf), [None] * len(pdf), 0
            for name, generator in generators.items():
                left = [i for i, a in enumerate(answers) if a is None]
                for _ in range(attempts if left else 0):
                    tries += 1
                    try:
                        found = generator(pdf["prompt"].iloc[left])
                    except Exception:  # a model may fail in any way
                        continue
                    for i, a in zip(left, found, strict=True):
                        answers[i], providers[i] = a, name if a is not None else None
                    break
            yield pd.DataFrame({"key": pdf["key"], "answer": answers, "provider": providers, "attempts": tries, "success": [a is not None for a in answers]})

    rows = prompts.select(F.col(key).alias("key"), F.coalesce(prompt, F.lit("")).alias("prompt"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, answer string, provider string, attempts int, success boolean").withColumnRenamed("key", key)


def max_sim(query_tokens: Column, doc_tokens: Column) -> Column:
    """Late interaction: for each query token its best cosine with a document token, summed."""
    best = F.transform(query_tokens, lambda a: F.array_max(F.transform(doc_tokens, lambda b: V.cosine(a, b))))
    return F.round(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), 6)


def best_sentence(question: Column, context: Column) -> Column:
    """The default generator: the sentence of the context with the most words of the question, the first of equals."""
    asked = F.filter(F.split(F.lower(question), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    sentences = F.filter(F.split(context, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    scored = F.transform(sentences, lambda x, i: F.struct((-F.size(F.array_intersect(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""), asked))).alias("s"), i.alias("i"), F.trim(x).alias("text")))
    return F.get(F.array_sort(scored), F.lit(0))["text"]
