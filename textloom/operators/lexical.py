"""BM25 over postings built in one pass, and analysis of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from ..sources.stored import stored
from .parallel import MOST_BROADCAST, SLICE, spread
from .postings import GATHERED, _most, _rounded

#: Parts of scores, and pairs of a query and a document, that a task adds up at a time.
PARTS = 1 << 21

# Abbreviations, expansions, keyword lists and weights of query analysis.
ABBREVIATIONS = {
    "hnsw": "hierarchical navigable small world", "ann": "approximate nearest neighbor", "fem": "finite element method",
    "cfd": "computational fluid dynamics", "dof": "degrees of freedom", "ram": "random access memory",
}
EXPANSIONS = {
    "FEM": "finite element method", "CFD": "computational fluid dynamics", "HNSW": "hierarchical navigable small world", "BM25": "best matching 25", "RRF": "reciprocal rank fusion",
}
EQUATION_WORDS = ("equation", "formula", "$$", "latex")
PROCEDURAL_WORDS = ("calculate", "compute", "solve", "derive", "step", "procedure", "method", "algorithm", "process")
EXPLORATORY_WORDS = ("overview", "survey", "introduction", "background", "review", "summary", "discuss")
CONCEPTUAL_WORDS = ("explain", "why", "how", "concept", "theory", "principle", "understand", "meaning", "significance")
TECHNICAL_TERMS = (
    "FEM", "CFD", "HNSW", "BM25", "RRF", "MTEB", "LaTeX", "PDF", "fuselage", "wing", "airfoil", "stress", "strain", "shear", "moment", "beam", "plate", "shell",
    "equation", "formula", "theorem", "proof", "derivative", "integral", "matrix", "tensor",
)
BASE_ALPHA = {"factual": 0.7, "equation": 0.8, "procedural": 0.6, "conceptual": 0.3, "exploratory": 0.2}
STRATEGY = {
    "factual": "Using BM25-heavy search for precise term matching",
    "equation": "Using strong BM25 for LaTeX equation matching",
    "procedural": "Using balanced hybrid search for step-by-step content",
    "conceptual": "Using semantic-heavy search for conceptual understanding",
    "exploratory": "Using strong semantic search for broad exploration",
}


def preprocess_query(text: Column) -> Column:
    """Lower case, whole-word abbreviations spelled out, marks to spaces, single spaces."""
    x = F.lower(text)
    for short, full in ABBREVIATIONS.items():
        x = F.regexp_replace(x, rf"\b{short}\b", full)
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s-]", " "), r"\s+", " "))


def _any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def query_type(text: Column) -> Column:
    """The first of equation, procedural, exploratory, conceptual that a keyword tells, else factual."""
    low = F.lower(text)
    rules = (("equation", EQUATION_WORDS), ("procedural", PROCEDURAL_WORDS), ("exploratory", EXPLORATORY_WORDS), ("conceptual", CONCEPTUAL_WORDS))
    out = F.when(_any(low, rules[0][1]), rules[0][0])
    for name, words in rules[1:]:
        out = out.when(_any(low, words), name)
    return out.otherwise("factual")


def query_alpha(text: Column, kind: Column) -> Column:
    """Weight of lexical search: by type, more for three technical terms and less for none."""
    low = F.lower(text)
    terms = F.size(F.filter(F.array(*(F.lit(t.lower()) for t in TECHNICAL_TERMS)), lambda t: F.contains(low, t)))
    base = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in BASE_ALPHA.items()))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(terms >= 3, 0.1).when(terms == 0, -0.1).otherwise(0.0))), 6)


def expand_query(text: Column) -> Column:
    return F.concat(text, *(F.when(F.contains(text, F.lit(k)), F.lit(" " + v)).otherwise("") for k, v in EXPANSIONS.items()))


def filters_v1(text: Column) -> dict[str, Column]:
    """Chapter or section, equations, pages (a single page is a range of one) and figures named in a query."""

    def number(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")

    pages = r"(?i)pages?\s+(\d+)(?:\s*-\s*(\d+))?"
    chapter = F.nullif(F.regexp_extract(text, r"(?i)(?:chapter|section)\s+(\d+)", 1), F.lit(""))
    return {
        "document_id": F.concat(F.lit("chapter_"), chapter),
        "has_equations": F.rlike(text, F.lit(r"(?i)with\s+equations?")),
        "page_gte": number(pages, 1),
        "page_lte": F.coalesce(number(pages, 2), number(pages, 1)),
        "has_figures": F.rlike(text, F.lit(r"(?i)with\s+figures?|diagrams?")),
    }


def filters_v2(text: Column) -> dict[str, Column]:
    """The stricter form: `in chapter n`, `with/containing/has equation or formula`, `pages a to b`."""

    def number(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("int")

    pages = r"(?i)pages?\s+(\d+)\s*(?:to|-)\s*(\d+)"
    return {
        "document_id": F.when(number(r"(?i)(?:in|from)\s+chapter\s+(\d+)").isNotNull(), F.format_string("chapter_%02d", number(r"(?i)(?:in|from)\s+chapter\s+(\d+)"))),
        "has_equations": F.rlike(text, F.lit(r"(?i)\b(with|containing|has)\s+(equation|formula)")),
        "page_number_min": number(pages, 1),
        "page_number_max": number(pages, 2),
    }


def analyze(queries: DataFrame, text: str = "query") -> DataFrame:
    """Add type, alpha, expansion, filters and an explanation; all in one projection's worth of expressions."""
    q = F.col(text)
    out = queries.withColumn("query_type", query_type(q)).withColumns({"alpha": query_alpha(q, F.col("query_type")), "expanded_query": expand_query(q), **filters_v1(q)})
    told = F.coalesce(*(F.when(F.col("query_type") == k, F.lit(v)) for k, v in STRATEGY.items()))
    return out.withColumn("strategy", F.format_string("Query type: %s. %s. Fusion weight: %.2f (0=semantic, 1=BM25).", "query_type", told, "alpha"))


# --- BM25 -----------------------------------------------------------------------------


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, term, tf); with `terms`, only those of a table with a `term` column.

    The terms wanted cut the exploded rows before they travel, once, to the
    place of their document, where all later sums over documents find them.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), T.tokens(F.col(text)).alias("t")).select("doc_id", F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    rows = rows if terms is None else rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents and their average length in tokens."""
    return docs.agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col(text)))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.ln((n - df + 0.5) / (df + 0.5) + 1)


def document_frequencies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, idf) of every term; a document's distinct terms are found before the shuffle."""
    terms = spread(docs.select(text)).select(F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(F.broadcast(docs.agg(F.count("*").alias("n")))).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _counted(terms):
    """Function of batches (doc_id, words), words with single spaces between them: (doc_id, dl, terms, tf), the numbers of those of `terms` that a text has and how often; a null text has no length."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, size = pa.array(terms.value, pa.string()), max(1, len(terms.value))
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                some = batch.slice(a, SLICE)
                lists = pc.split_pattern(some["words"].fill_null(""), " ")
                words = lists.flatten()
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                lengths = np.bincount(row[pc.not_equal(words, "").to_numpy(zero_copy_only=False)], minlength=len(lists))
                code = pc.index_in(words, value_set=wanted)
                key, times = np.unique(row[code.is_valid().to_numpy(zero_copy_only=False)] * size + code.drop_null().to_numpy(), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(lists) + 1) * size).astype(np.int32))
                found = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (key % size, times))
                yield pa.record_batch([some["doc_id"], pa.array(lengths, pa.int64(), mask=some["words"].is_null().to_numpy(zero_copy_only=False)), *found], ["doc_id", "dl", "terms", "tf"])

    return counted


def _relevance(held, n: int, avgdl: float, k: int | None, k1: float, b: float):
    """Function of batches (doc_id, dl, terms, tf): (query, doc_id, score), the k best of each query in a task, or all that share a term.

    `held` has for each term its frequency and where its queries begin in the
    two arrays that follow (numbers of queries, and how often each asks), and
    how many queries there are.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, starts, queries, asks, most = held.value
        weights = np.log((n - df + 0.5) / (df + 0.5) + 1)

        def scored(terms: np.ndarray, tf: np.ndarray, dl: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            part = weights[terms] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
            times = starts[terms + 1] - starts[terms]
            ends = np.cumsum(times)
            at = np.repeat(starts[terms] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
            key = queries[at] * rows + np.repeat(row, times)
            sums = np.bincount(key, np.repeat(part, times) * asks[at])
            key = np.flatnonzero(sums)  # each part is over 0
            return key // rows, key % rows, _rounded(sums[key])

        found, gathered = [], 0
        for batch in batches:
            ids, dl = batch["doc_id"], batch["dl"].fill_null(0).to_numpy()
            offsets = batch["terms"].offsets.to_numpy().astype(np.int64)
            terms, tf = (batch[c].flatten().to_numpy() for c in ("terms", "tf"))
            offsets = offsets - offsets[0]
            work = np.concatenate(([0], np.cumsum(starts[terms + 1] - starts[terms])))[offsets]
            a = 0
            while a < len(ids):
                z = min(max(a + 1, int(np.searchsorted(work, work[a] + PARTS, "right")) - 1), a + max(1, PARTS // max(1, most)), len(ids))
                own = slice(offsets[a], offsets[z])
                row = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
                query, doc, score = scored(terms[own], tf[own].astype(np.int64), dl[a:z], row, z - a)
                docs = ids.take(pa.array(doc + a)).to_numpy(zero_copy_only=False)
                found.append((query, docs, score) if k is None else _most(query, docs, score, k))
                gathered, a = gathered + len(found[-1][0]), z
                if gathered > GATHERED:
                    best = tuple(map(np.concatenate, zip(*found, strict=True)))
                    if k is None:
                        yield pa.record_batch(list(map(pa.array, best)), ["query", "doc_id", "score"])
                    found = [] if k is None else [_most(*best, k)]
                    gathered = 0
        if found:
            best = tuple(map(np.concatenate, zip(*found, strict=True)))
            yield pa.record_batch(list(map(pa.array, best if k is None else _most(*best, k))), ["query", "doc_id", "score"])

    return search


def _bm25_in_place(asked: DataFrame, docs: DataFrame, k: int | None, k1: float, b: float) -> DataFrame | None:
    """`bm25` of few terms (query_id, term, qtf), or None if the documents repeat a doc_id or lack one."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    rows = asked.collect()
    terms, ids = sorted({r["term"] for r in rows}), list({r["query_id"]: None for r in rows})
    held = spark.sparkContext.broadcast(terms)
    texts = docs.select(F.col("doc_id").cast("long"), T.words(F.col("text")).alias("words"))
    counted = stored(texts.mapInArrow(_counted(held), "doc_id long, dl long, terms array<int>, tf array<int>"), "counted")
    if not counted.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return None
    n, avgdl = counted.agg(F.count("*"), F.avg("dl")).first()
    df = np.zeros(len(terms))
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # terms of the queries only
        df[r["term"]] = r["count"]
    term, query = ({x: i for i, x in enumerate(xs)} for xs in (terms, ids))
    asks = np.array(sorted((term[r["term"]], query[r["query_id"]], r["qtf"]) for r in rows), np.int64).reshape(-1, 3)
    plan = spark.sparkContext.broadcast((df, np.searchsorted(asks[:, 0], np.arange(len(terms) + 1)), asks[:, 1], asks[:, 2], len(ids)))
    scored = counted.mapInArrow(_relevance(plan, n, avgdl or 1.0, k, k1, b), "query long, doc_id long, score double")
    names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("query", LongType()), asked.schema["query_id"]]))
    scored = scored.join(F.broadcast(names), "query").select("query_id", F.col("doc_id").cast(kind).alias("doc_id"), "score")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """ranked: query_id, doc_id, score, rank of each query's best documents (all that share a term, if k is None).

    A term that a query repeats counts each time. Scores are rounded to nine
    places before ranking; ties go to the smaller doc_id. Up to MOST_BROADCAST
    terms of queries are held by every task: a text is read once, what it has
    of them is stored, and its scores add up where that is, so no posting
    travels and a task hands on k documents for each query. With more of them,
    or where rows repeat a doc_id or have none, postings meet by joins.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    few = asked.count() <= MOST_BROADCAST
    docs = spread(docs)
    if few and docs.schema["doc_id"].dataType.typeName() in ("integer", "long") and (found := _bm25_in_place(asked, docs, k, k1, b)) is not None:
        return found
    small = F.broadcast if few else lambda df: df
    post = postings(docs, terms=small(asked.select("term").distinct()))
    df = small(post.groupBy("term").agg(F.count("*").alias("df")))
    stats = F.broadcast(corpus_stats(docs))
    length = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + length)
    scored = post.join(df, "term").join(small(asked), "term").join(stats).groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(best))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def all_terms(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of documents that have all terms of a query, an array `terms`; a query without terms has none."""
    asked = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("term")).join(queries.select("query_id", F.size(F.array_distinct("terms")).alias("need")), "query_id")
    small = F.broadcast if asked.count() <= MOST_BROADCAST else lambda df: df
    words = spread(docs).select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    met = words.join(small(asked), "term").groupBy("query_id", "doc_id", "need").agg(F.count("*").alias("n"))
    return met.where("n = need").select("query_id", "doc_id")


def _held_by(held):
    """Function of batches (doc_id, text): (query, doc_id), the numbers of the passages that a text holds. `held` has the passages and the word of each by which texts meet it, if any."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages, words = held.value
        by_word: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            by_word.setdefault(word, []).append(i)
        everywhere, known = by_word.pop(None, []), pa.array(by_word, pa.string())
        by_code = list(by_word.values())
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                some = batch.slice(a, SLICE)
                lists, texts = pc.split_pattern(some["text"], " "), some["text"].cast(pa.binary())
                code = pc.index_in(lists.flatten(), value_set=known)
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[code.is_valid().to_numpy(zero_copy_only=False)]
                met = np.unique(row * max(1, len(known)) + code.drop_null().to_numpy())
                rows, queries = [], []
                for i, own in [(k // len(known), by_code[k % len(known)]) for k in met.tolist()] + [(i, everywhere) for i in range(len(texts) if everywhere else 0)]:
                    text = texts[i].as_py()
                    holds = [q for q in own if passages[q] in text]
                    queries += holds
                    rows += [i] * len(holds)
                yield pa.record_batch([pa.array(queries, pa.int64()), some["doc_id"].take(pa.array(rows, pa.int64()))], ["query", "doc_id"])

    return found


def holding(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id) of all documents that hold a passage whole; passages are (query_id, query).

    The inner words of a passage, those between its first and its last space,
    are words of every text that holds it. So texts meet passages by the
    longest inner word and are then searched, in the task that reads them
    while there are MOST_BROADCAST passages at most, else by joins. A passage
    without inner words is looked for in all texts.
    """
    words = F.split("query", " ")
    inner = F.array_remove(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), "")
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    asked = passages.where("query IS NOT NULL").select("query_id", "query", longest.alias("word"))
    texts = spread(docs.select("doc_id", "text"))
    if asked.count() <= MOST_BROADCAST:
        rows = asked.collect()
        held = docs.sparkSession.sparkContext.broadcast(([r["query"].encode() for r in rows], [r["word"] for r in rows]))
        names = docs.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], StructType([StructField("query", LongType()), asked.schema["query_id"]]))
        found = texts.where("text IS NOT NULL").mapInArrow(_held_by(held), StructType([StructField("query", LongType()), docs.schema["doc_id"]]))
        return found.join(F.broadcast(names), "query").select("query_id", "doc_id").distinct()
    known = asked.where("word IS NOT NULL").select("word").distinct()
    met = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).join(known, "word", "left_semi").join(asked, "word").select("query_id", "query", "doc_id")
    found = met.join(texts, "doc_id").where(F.contains("text", F.col("query")))
    rest = asked.where("word IS NULL")
    return found.select("query_id", "doc_id").unionByName(texts.join(rest, F.contains("text", F.col("query"))).select("query_id", "doc_id")).distinct()


def fetched(found: DataFrame, docs: DataFrame) -> DataFrame:
    """`found` (doc_id and other columns) with the rows of `docs`; it is stored, and every task holds it if it has MOST_BROADCAST rows at most, so that no text of another document travels."""
    found = stored(found, "found")
    return (F.broadcast(found) if found.count() <= MOST_BROADCAST else found).join(docs, "doc_id")


# --- fusion ---------------------------------------------------------------------------


def rrf(semantic: DataFrame, lexical: DataFrame, semantic_weight: float | Column = 0.5, k: int = 60, top: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of two `ranked` tables by one full outer join on (query_id, doc_id).

    `weights` (query_id, semantic_weight) gives each query a weight of its own.
    """
    a = semantic.select("query_id", "doc_id", F.col("rank").alias("semantic_rank"))
    b = lexical.select("query_id", "doc_id", F.col("rank").alias("lexical_rank"))
    fused = a.join(b, ["query_id", "doc_id"], "full_outer")
    w = F.lit(semantic_weight) if isinstance(semantic_weight, float) else semantic_weight
    if weights is not None:
        fused, w = fused.join(weights.select("query_id", F.col("semantic_weight").alias("_w")), "query_id"), F.col("_w")
    score = F.coalesce(w / (k + F.col("semantic_rank")), F.lit(0.0)) + F.coalesce((1 - w) / (k + F.col("lexical_rank")), F.lit(0.0))
    fused = fused.withColumn("score", F.round(score, 9)).drop("_w")
    fused = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return fused if top is None else fused.where(F.col("rank") <= top)


def weighted(semantic: DataFrame, lexical: DataFrame, text_weight: float = 0.3, top: int = 10) -> DataFrame:
    """Weighted sum of two scores; a missing side counts 0."""
    a = semantic.select("query_id", "doc_id", F.col("score").alias("vector_score"))
    b = lexical.select("query_id", "doc_id", F.col("score").alias("text_score"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer").na.fill(0.0, ["vector_score", "text_score"])
    both = both.withColumn("score", F.round(F.col("vector_score") * (1 - text_weight) + F.col("text_score") * text_weight, 9))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= top)
