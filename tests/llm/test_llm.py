"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from textloom.llm import block_search, bpe, exact_dedup, near_dedup, packing, quality, queries, sharding, storage, token_lengths, tokens, warc, wavelet

PATH = tokens.tokenizer_path(tokens.WORD_BPE)
ODD = ["", " ", "İstanbul ΣΑΣ. don't we'll  x\ty z", "école, a<|endoftext|>b <|endoftext|>", "A <|endoftext|> B<|ENDOFTEXT|>C <|startoftext|>.", "<|endoftext|> x", "x" * 5000, "日本語 テスト。 ①②", "A\x1cB \x85 c", ".,", "a.b,c.. ..", "ﬁ Å, K", "́ a", "naïve,", "Plain words. Plain words,\nmore", "🙂 x"]
SCHEMA = "doc_id long, text string, piece string, length int"


def corpus(spark, extra=()):
    """Texts of the smallest corpus with odd ones, nulls and repeats, and columns whose names clash with results."""
    rows = [(r["doc_id"], r["text"], "clash", 1) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows += [(10_000 + i, t, "clash", 2) for i, t in enumerate([*ODD, *extra])] + [(20_000, None, None, None), (20_001, None, None, None), (None, "lost id", None, None), (5, rows[5][1], "again", 3)]
    return spark.createDataFrame(rows, SCHEMA), rows


@pytest.fixture(scope="module")
def reference_encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


# --- tokenizers -----------------------------------------------------------------------


def test_word_encoder_equals_the_library(reference_encoder):
    ids, starts = tokens.word_bpe(PATH).encode(pa.array([*ODD, None]))
    for i, text in enumerate([*ODD, None]):
        assert ids[starts[i] : starts[i + 1]].tolist() == reference_encoder(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=30), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "Ab", "."]))).map("".join), min_size=1, max_size=5))
def test_word_encoder_on_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids, starts = tokens.word_bpe(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def byte_encoders():
    import public_tokenizers
    import tiktoken

    own = bpe.byte_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet=" \n\tab'sé1.\x1c\x85　\0", max_size=16), st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=20)), min_size=1, max_size=4))
def test_byte_bpe_equals_tiktoken(texts):
    own, other = byte_encoders()
    ids, starts = own.encode(pa.array(texts))
    for i, text in enumerate(texts):
        part = ids[starts[i] : starts[i + 1]].tolist()
        assert part == other.encode_ordinary(text)
        assert own.decode(part) == text.encode()


def test_byte_bpe_of_very_long_pre_tokens():
    own, other = byte_encoders()
    r = random.Random(1)
    for text in ("a" * 4000, "ab" * 3000, "".join(r.choice("abcdefgh") for _ in range(50_000)), "é" * 999):
        assert np.frombuffer(own.merge([text.encode()])[0], "<u4").tolist() == other.encode_ordinary(text)


def test_op8_round_trip(spark):
    docs, rows = corpus(spark)
    _, other = byte_encoders()
    import public_tokenizers

    got = Counter(tuple(r) for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = other.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(docs.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


# --- token counts ---------------------------------------------------------------------


def test_op3_answers_every_limit(spark, reference_encoder):
    docs, rows = corpus(spark)
    n = [len(reference_encoder(r[1])) for r in rows]
    table = token_lengths.context_table(token_lengths.length_histogram(docs, PATH), block=64)
    got = {r["context_limit"]: r for r in table.collect()}
    assert set(got) == set(n)
    for limit, row in got.items():
        assert row["n_docs"] == n.count(limit) and row["docs_ge"] == sum(x >= limit for x in n) and row["tokens_ge"] == sum(x for x in n if x >= limit)
        assert row["kept_tokens"] == sum(min(x, limit) for x in n) and row["cut_tokens"] == sum(n) - row["kept_tokens"]
    assert token_lengths.length_quantiles(table, [0.5]).first()["n_tokens"] == sorted(n)[-(-len(n) // 2) - 1]
    assert token_lengths.context_table(token_lengths.length_histogram(docs.limit(0), PATH)).count() == 0
    by = token_lengths.context_table(token_lengths.length_histogram(docs, PATH, by="piece"))
    assert by.agg(F.sum("n_docs")).first()[0] == len(rows)


# --- packing --------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 60))
def test_bin_completion_packs_the_histogram(lengths, capacity):
    counts = Counter(lengths)
    found = packing.bin_completion(counts, capacity, nodes=300)
    for plan in (packing.best_fit(counts, capacity), found.patterns):
        used = Counter()
        for repeats, items in plan:
            assert sum(n * k for n, k in items) <= capacity
            for n, k in items:
                used[n] += repeats * k
        assert used == counts
    assert found.bound <= found.sequences == sum(r for r, _ in found.patterns) <= sum(r for r, _ in packing.best_fit(counts, capacity))


def test_bin_completion_beats_best_fit():
    counts, capacity = Counter([5, 4, 4, 3, 2, 2]), 10
    assert sum(r for r, _ in packing.best_fit(counts, capacity)) == 3
    assert packing.bin_completion(counts, capacity).sequences == 2


def fewest(items, capacity):
    """Fewest sequences by trying every place of every item."""
    best = len(items)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(items):
            best = len(room)
            return
        for j in range(len(room)):
            if items[i] <= room[j] and room[j] not in room[:j]:
                put(i + 1, [*room[:j], room[j] - items[i], *room[j + 1 :]])
        put(i + 1, [*room, capacity - items[i]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(3, 20), max_size=11))
def test_bin_completion_proves_the_fewest(lengths):
    found = packing.bin_completion(Counter(lengths), 30, nodes=10**6, branch=10**6, steps=10**6)
    assert found.proved and found.sequences == fewest(sorted(lengths, reverse=True), 30)
    quick = packing.bin_completion(Counter(lengths), 30)
    assert not quick.proved or quick.sequences == found.sequences


def test_bin_completion_beats_best_fit_on_many_lengths():
    r = random.Random(3)
    counts = Counter(r.randint(300, 900) for _ in range(400))
    found = packing.bin_completion(counts, 2048)
    assert found.proved and found.sequences == 118 < sum(n for n, _ in packing.best_fit(counts, 2048))


@pytest.mark.parametrize("short", [2500, 250_000])
def test_thousands_of_one_token_pieces(short):
    counts = {1: short, 248: 12, 305: 21, 766: 24, 629: 22}
    found = packing.bin_completion(counts, 2048)
    used = Counter()
    for repeats, items in found.patterns:
        assert sum(n * k for n, k in items) <= 2048
        for n, k in items:
            used[n] += repeats * k
    assert used == counts and found.proved and found.sequences == found.bound == -(-sum(k * n for k, n in counts.items()) // 2048)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=12), st.integers(1, 25))
def test_completions_are_the_undominated_fillings(lengths, room):
    """All maximal fillings, one by one, of which each is kept or put into one that is."""
    counts = Counter(lengths)
    kinds = sorted(counts)
    found, whole = packing.completions(room, kinds, counts, 10**6, 10**6)
    assert whole
    for times in itertools.product(*(range(counts[k] + 1) for k in kinds)):
        left = room - sum(k * n for k, n in zip(kinds, times))
        if left < 0 or any(n < counts[k] and k <= left for k, n in zip(kinds, times)):
            continue
        filling = tuple((k, n) for k, n in zip(kinds[::-1], times[::-1]) if n)
        assert any(packing.fits_into(filling, other) for other in found)
    for filling in found:
        assert sum(k * n for k, n in filling) <= room and all(n <= counts[k] for k, n in filling)


def test_fits_into_is_first_fit_decreasing():
    def one_by_one(items, places):
        room = [k for k, n in places for _ in range(n)]
        for item in (k for k, n in items for _ in range(n)):
            at = next((i for i, left in enumerate(room) if left >= item), None)
            if at is None:
                return False
            room[at] -= item
        return True

    rng = random.Random(5)
    for _ in range(2000):
        make = lambda most: tuple((k, rng.randint(1, 4)) for k in sorted(rng.sample(range(1, most), 3), reverse=True))
        items, places = make(6), make(12)
        assert packing.fits_into(items, places) == one_by_one(items, places)


def test_unproved_search_says_so():
    r = random.Random(3)
    counts = Counter(r.randint(682, 1100) for _ in range(500))
    assert not packing.bin_completion(counts, 2048, nodes=50).proved


def test_op2_packs_every_piece(spark, reference_encoder):
    docs, rows = corpus(spark, ["word " * 9000])
    got = packing.pack(packing.token_pieces(docs, PATH, 0, 2048), report=True).collect()
    assert {(r["n_sequences"], r["proved_fewest"]) for r in got} == {(len({r["sequence_id"] for r in got}), True)} and got[0]["sequences_bound"] <= got[0]["n_sequences"]
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*reference_encoder(text), 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 2048) + 2
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH)).count() == 0
    clash = packing.token_pieces(docs, PATH).withColumns({"_bucket": F.lit("x"), "_rank": F.lit("y"), "offset": F.lit("z"), "c0": F.lit(1)})
    again = packing.pack(clash)
    assert again.columns == [*clash.columns, "sequence_id", "_offset"] and again.where("_bucket = 'x' AND _rank = 'y' AND offset = 'z'").count() == clash.count()


# --- exact dedup ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    levels = exact_dedup.build_hash(keys)
    assert sorted(exact_dedup.look_up(levels, keys).tolist()) == list(range(n))


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id > 100"])
def test_op7_equals_grouping(spark, history):
    docs, rows = corpus(spark, ["Same TEXT", "same text", "SAME text", "sAme É", "same é"])
    groups = defaultdict(list)
    sha = lambda t: hashlib.sha256((t or "").encode().lower()).hexdigest()
    for doc_id, text, *_ in rows:
        groups[sha(text)].append(doc_id)
    got = exact_dedup.exact_duplicates(docs, history and F.expr(history), per_block=64).collect()
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((r[0], sha(r[1])) for r in rows)
    kept = Counter()
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}
    stay = exact_dedup.without_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


# --- near dedup -----------------------------------------------------------------------


def test_samples_collide_as_weighted_jaccard():
    r = np.random.default_rng(3)
    names = np.sort(r.integers(1, 2**63, 400).astype(np.uint64))
    w = r.uniform(0.3, 3, 400)
    other = w * r.uniform(0.5, 1.5, 400)
    starts = np.array([0, 400, 800])
    found = near_dedup.samples(np.concatenate((names, names)), np.log(np.concatenate((w, other))).astype(np.float32), starts, 2000)
    truth = np.minimum(w, other).sum() / np.maximum(w, other).sum()
    assert abs((found[0] == found[1]).mean() - truth) < 0.04


def test_op4_finds_all_links(spark):
    r = random.Random(7)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [[r.choice(words) for _ in range(200)] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for b in base[:10]:
        for _ in range(6):
            c = list(b)
            for _ in range(r.randint(1, 3)):
                c[r.randrange(200)] = r.choice(words)
            texts.append(" ".join(c))
    texts += [texts[0].upper() + "!", texts[1], "short text", "Short, text.", "another one", "", "  ", None]
    rows = list(enumerate(texts)) + [(None, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: c for i, c, *_ in near_dedup.near_duplicates(docs).collect() if i is not None}

    def shingles(t):
        w = [x for x in (p.lower().strip(near_dedup._EDGE) for p in (t or "").split()) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)])

    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {i: root(i) for i in range(len(texts))}
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct().count()
    assert kept == len({root(i) for i in range(len(texts))})
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def brute_force_classes(texts, threshold=0.8):
    """The least index of the texts that plain links join with each."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [root(i) for i in range(len(texts))]


def near_copies(seed, n, edits, length):
    """Texts that copy one text with some words each replaced at even distances, so few of them are links."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(length)]
    texts = []
    for i in range(n):
        c = list(base)
        for k in r.sample(range(2, length - 2, 5), r.choice(edits)):
            c[k] = f"e{k}"
        texts.append(" ".join(c))
    return texts


def test_op4_finds_all_links_of_a_large_group(spark):
    texts = near_copies(11, 400, (4, 5), 200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: c for i, c, *_ in near_dedup.near_duplicates(docs).collect()}
    truth = brute_force_classes(texts)
    assert len(set(truth)) == 8
    assert got == dict(enumerate(truth))


def test_op4_links_rows_of_null_id(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join([*base[:50], f"e{i}", *base[51:]]) for i in range(6)]
    docs = spark.createDataFrame([(None, t) for t in texts] + [(1, "another text of some more words than five")], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in got) == [(0, 0, 6)] * 6 + [(1, 1, 1)]
    assert sum(r["kept"] for r in got if r["doc_id"] is None) == 1


def test_op4_blocks_equal_pairs(spark):
    """Blocks of any size join what all pairs join."""
    texts = near_copies(5, 120, (2, 3, 4, 5), 120)
    docs = spark.createDataFrame([(t,) for t in texts], "_text string")
    features = near_dedup._features(docs, 5).groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("counts").alias("counts"))
    weights = spark.sparkContext.broadcast(near_dedup.Weights(len(texts), 16, np.empty(0, np.uint64), np.empty(0)))
    apart = features.select(F.lit(0).alias("band"), F.lit(1).cast("long").alias("key"), "node", F.col("node").alias("root"))
    pairs = apart.select(F.col("node").alias("a")).crossJoin(apart.select(F.col("node").alias("b"))).where("a < b")
    classes = []
    for links in (near_dedup._verified(pairs, features, weights, 0.8), near_dedup._compared(apart, features, weights, 0.8, block=20), near_dedup._compared(apart, features, weights, 0.8, block_bytes=20_000)):
        classes.append({bytes(r["node"]): bytes(r["root"]) for r in near_dedup.components(links).collect()})
    assert len(set(classes[0].values())) > 1 and classes[0] == classes[1] == classes[2]


def test_op4_frequencies_are_exact_however_the_table_is_split(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("text").alias("_text"))
    docs = docs.unionByName(docs).unionByName(docs)
    truth = Counter()
    for r in docs.collect():
        words, starts = near_dedup.word_hashes(pa.array([r["_text"]]))
        truth.update(near_dedup.shingles(words, starts)[0].tolist())
    n = docs.count()
    for parts, block in ((1, 8192), (5, 8192), (7, 64)):
        with storage.Scratch(spark) as scratch:
            floor, names, df = near_dedup.frequent_shingles(docs.repartition(parts), n, 1 << 20, scratch, block_docs=block)
        assert floor == 16 and dict(zip(names.tolist(), df.tolist(), strict=True)) == {k: v for k, v in truth.items() if v > 16}


def test_op4_weighted_links_with_inverse_document_frequency(spark):
    """Texts share a frequent passage; by weight they are apart, as plain sets they are alike, and `plain` tells which counts."""
    passage = " ".join(f"p{i}" for i in range(100))
    texts = [f"{passage} {' '.join(f'e{i}x{j}' for j in range(12))}" for i in range(40)] + [" ".join(f"u{i}x{j}" for j in range(40)) for i in range(60)]
    texts += [" ".join([*texts[60].split()[:1], "changed", *texts[60].split()[2:]]), " ".join(texts[70].split()[:39])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = []
    for t in texts:
        words, starts = near_dedup.word_hashes(pa.array([t]))
        sets.append(dict(zip(*(x.tolist() for x in near_dedup.shingles(words, starts)[:2]), strict=True)))
    n, df = len(texts), Counter(h for s in sets for h in s)
    idf = lambda x: np.log(1.01 * n / (max(x, 16) + 0.01 * n)) / np.log(1.01 * n / (16 + 0.01 * n))
    weighed = [{h: c * max(idf(df[h]), 1e-3) for h, c in s.items()} for s in sets]
    for plain in (True, False):
        parent = list(range(n))
        for a, b in itertools.combinations(range(n), 2):
            both = sets[a].keys() & sets[b].keys()
            low = sum(min(weighed[a][h], weighed[b][h]) for h in both)
            alike = low / (sum(weighed[a].values()) + sum(weighed[b].values()) - low)
            if alike >= 0.8 or plain and len(both) >= 0.8 * len(sets[a].keys() | sets[b].keys()):
                parent = [parent[a] if x == parent[b] else x for x in parent]
        least = {r: min(i for i in range(n) if parent[i] == r) for r in set(parent)}
        assert len(least) == (61 if plain else 100)
        assert {i: c for i, c, *_ in near_dedup.near_duplicates(docs, plain=plain).collect()} == {i: least[parent[i]] for i in range(n)}


def test_unit_samples_equal_samples_of_unit_weight():
    r = np.random.default_rng(4)
    names = np.sort(r.integers(1, 2**63, 300).astype(np.uint64))
    lw = np.where(r.random(300) < 0.5, 0, np.log(r.uniform(0.2, 9, 300))).astype(np.float32)
    starts, unit = np.array([0, 100, 100, 300]), np.zeros((3, 50), np.uint32)
    weighted = near_dedup.samples(names, lw, starts, 50, unit=unit)
    assert (unit == near_dedup.samples(names, np.zeros(300, np.float32), starts, 50)).all() and (unit != weighted).any()


def test_op4_joins_equal_sets_of_different_frequencies(spark):
    """The same lines repeated 50 and 5 times: plain similarity 1, weighted 0.1."""
    texts = []
    for i in range(20):
        line = " ".join(f"w{i}x{j}" for j in range(12))
        texts += [" ".join([line] * 50), " ".join([line] * 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {i: c for i, c, *_ in near_dedup.near_duplicates(docs).collect()} == {i: i - i % 2 for i in range(40)}


@pytest.mark.parametrize("few", [0, 500_000])
def test_components_of_a_long_chain(spark, few):
    name = lambda i: hashlib.md5(str(i).encode()).digest()
    links = spark.createDataFrame([(bytearray(name(i)), bytearray(name(i + 1))) for i in range(40)] + [(bytearray(name(100)), bytearray(name(101)))], "a binary, b binary")
    roots = {bytes(r["node"]): bytes(r["root"]) for r in near_dedup.components(links, few=few).collect()}
    assert len({roots[name(i)] for i in range(41)}) == 1 and roots[name(100)] == roots[name(101)] != roots[name(0)]
    assert roots[name(0)] == min(name(i) for i in range(41))


# --- search ---------------------------------------------------------------------------


def test_op5_equals_brute_force(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(300, 16)).astype(np.float32)
    v[7] = v[8] = v[9]
    rows = [(i, v[i].tolist()) for i in range(300)] + [(300, None), (320, [0.0] * 16), (340, [float("nan")] * 16), (360, [None] * 16), (None, v[0].tolist()), (400, []), (420, [1.0, 2.0]), (421, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for x in block_search.nearest(frame, F.col("id") % 20 == 0, 20, query_block=5, vector_block=64).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    d = v.astype(np.float64)
    assert set(got) == {*range(0, 300, 20), 420}
    for q in range(0, 300, 20):
        score = d @ d[q]
        want = sorted((-score[i], i) for i in range(300) if i != q)[:20]
        found = sorted(got[q])
        assert [i for _, i, _ in found] == [i for _, i in want]
        assert np.allclose([s for *_, s in found], [-s for s, _ in want], rtol=0, atol=1e-12)
    assert [(rank, i) for rank, i, _ in got[420]] == [(1, 421)]
    assert block_search.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("dim", [1536, 4096])
def test_op5_wide_vectors(spark, dim):
    """Components of one sign add up to products that float32 can't hold exactly."""
    r = np.random.default_rng(dim)
    v = np.abs(r.normal(size=(120, dim))).astype(np.float32) * 0.001 + 1
    frame = spark.createDataFrame([(i, x.tolist(), "clash", 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, id string, v int")
    got = defaultdict(list)
    for x in block_search.nearest(frame, F.col("id") % 20 == 0, 5, query_block=3, vector_block=16).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"]))
    d = v.astype(np.float64)
    for q in range(0, 120, 20):
        score = d @ d[q]
        assert [i for _, i in sorted(got[q])] == sorted((i for i in range(120) if i != q), key=lambda i: (-score[i], i))[:5]
    a, b = (r.integers(-127, 128, (20, dim)).astype(np.int8) for _ in range(2))
    assert (block_search.products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()
    assert (block_search.products(np.full((2, dim), 127, np.int8), np.full((2, dim), 127, np.int8)) == 127 * 127 * dim).all()


def test_op5_ties_across_tiles(spark):
    frame = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(60)], "vec_id long, embedding array<double>")
    got = [(x["query_id"], x["rank"], x["vec_id"]) for x in block_search.nearest(frame, F.col("id") == 1, 7, vector_block=4).collect()]
    assert sorted(got) == [(1, k + 1, 3 + 2 * k) for k in range(7)]


# --- classifier -----------------------------------------------------------------------


def test_op6_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(4)) == 0
    rated = quality.grades(labels)
    model = quality.fit(docs, rated.where(~held), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.score(docs, model).join(rated.where(held), "doc_id").toPandas()
    kept = got["tail"] >= 0.5
    assert kept[got["grade"] == 2].mean() > 0.97
    assert kept[got["grade"] < 2].mean() < 0.2
    assert got["expected_grade"].between(0, 2).all()


def plain_features(text):
    """The features of a text as a set of numbers, by a loop over its pieces."""
    import xxhash

    pieces = (text or "").replace("\n", " ").split(" ")
    found, shapes, repeats = set(), Counter(), 0
    for i, piece in enumerate(pieces):
        word = piece.strip(".,;:!?\"'()[]")
        found.add(xxhash.xxh3_64_intdigest(word.lower().encode()) >> 4)
        if piece.isalpha() or word.isalpha():
            shape = "loud" if piece.endswith("!") else "all capitals" if len(word) > 1 and word.isupper() else "capital first" if word[:1].isupper() else "letters"
        else:
            shape = "digits" if word.isdigit() else "marks" if not any(c.isalnum() for c in piece) else "mixed"
        shapes[shape] += 1
        repeats += i > 0 and piece == pieces[i - 1]
    n, extra = len(pieces), []
    for i, share in enumerate([*(shapes[s] / n for s in quality.SHAPES), repeats / n, 1 - len(found) / n]):
        extra.append(sum(share >= e for e in quality.EDGES) + 16 * (i + 1))
    return found | {-1 - e for e in extra} | {-1 - (int(np.log2(n)) + 256)}


def test_op6_features_and_scores_equal_plain_loops(spark):
    docs, rows = corpus(spark)
    texts = [r[1] for r in rows][:80] + ODD
    flat, starts = quality.text_features(pa.array(texts))
    assert [set(flat[a:b].tolist()) for a, b in zip(starts, starts[1:], strict=False)] == [plain_features(t) for t in texts]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit(docs, quality.grades(labels), 3)
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    got = quality.score(docs, model, keep=("doc_id", "text")).collect()
    for r in got[:60] + got[-8:]:
        s = sum(weights.get(f, 0.0) for f in plain_features(r["text"]))
        tails = [1 / (1 + np.exp(-(s - t))) for t in model.thresholds]
        assert abs(r["expected_grade"] - sum(tails)) < 1e-9 and abs(r["tail"] - tails[-1]) < 1e-9


def test_op6_fit_is_the_penalised_maximum():
    """At the fitted weights no small step raises the penalised likelihood by more than a trace."""
    r = np.random.default_rng(6)
    sets = [r.choice(12, r.integers(1, 6), replace=False) for _ in range(400)]
    score = np.array([(s < 4).sum() - (s > 8).sum() + r.normal() for s in sets])
    grades = np.digitize(score, [-0.5, 1.0])
    flat, starts = np.concatenate(sets).astype(np.int64), np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    penalty = 1e-3
    model = quality.fit_ordinal(flat, starts, grades, 3, penalty=penalty, steps=1500)

    def likelihood(weights, thresholds):
        of = dict(zip(model.features.tolist(), weights, strict=True))
        total = 0.0
        for s, g in zip(sets, grades, strict=True):
            x = sum(of.get(int(f), 0.0) for f in s)
            tail = [1.0, *(1 / (1 + np.exp(-(x - t))) for t in thresholds), 0.0]
            total += np.log(tail[g] - tail[g + 1])
        return total / len(sets) - penalty / 2 * float(np.square(weights).sum())

    best = likelihood(model.weights, model.thresholds)
    for i in range(len(model.weights)):
        for step in (-0.02, 0.02):
            moved = model.weights.copy()
            moved[i] += step
            assert likelihood(moved, model.thresholds) < best + 1e-5
    for i in range(2):
        for step in (-0.02, 0.02):
            moved = model.thresholds.copy()
            moved[i] += step
            assert likelihood(model.weights, moved) < best + 1e-5


def test_op6_sample_stays_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"good text {i}", "x", 1) for i in range(90)], "doc_id long, text string, grade string, features int")
    rated = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (2, 2)], "doc_id long, grade int")
    model = quality.fit(docs, rated, 3, sample_rows=20)
    assert len(model.thresholds) == 2 and quality.score(docs, model).count() == 90
    kept = quality.select(docs.withColumns({"tail": F.lit(1), "expected_grade": F.lit(2)}), model, 0.0)
    assert kept.count() == 90 and kept.columns == [*docs.columns, "tail", "expected_grade"]


def test_op6_edges(spark):
    docs, _ = corpus(spark)
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, grade int"), 3)
    scored = quality.score(docs, none)
    assert scored.count() == docs.count() and scored.where("tail IS NULL").count() == 0
    assert quality.score(docs.limit(0), none).count() == 0


# --- files ----------------------------------------------------------------------------


def test_wavelet_matrix():
    r = np.random.default_rng(2)
    values = r.integers(0, 1000, 70_003).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.of(values, 10)
    assert (matrix.all() == values).all()
    at = r.integers(0, len(values), 500)
    assert (matrix.access(at) == values[at]).all()
    for x in (int(values[0]), 999, 1023, 5000):
        assert matrix.occurrences(x).tolist() == np.flatnonzero(values == x).tolist()
        assert matrix.count(x, 100, 64_000) == int((values[100:64_000] == x).sum())
    empty = wavelet.WaveletMatrix.of(values[:0], 10)
    assert len(empty.all()) == 0 and empty.count(3) == 0


def test_op9_files_give_the_ids(spark, reference_encoder):
    docs, rows = corpus(spark, ["word " * 3000])
    path = wavelet.write_shards(docs, PATH, 1, shard_tokens=2000, part_bytes=50_000)
    got = wavelet.read_documents(spark, path).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*reference_encoder(text), 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda x: (x[1], x[2])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert wavelet.count_token(spark, path, 1).agg(F.sum("n")).first()[0] == sum(([*reference_encoder(r[1]), 1]).count(1) for r in rows)
    empty = wavelet.write_shards(docs.limit(0), PATH)
    assert wavelet.read_documents(spark, empty).count() == 0


def test_op10_archives(spark):
    mark = warc.VERSION
    big = "é" * 3000
    pages = [
        (1, "http://a/ b\n", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "u", big), (8, "u", big), (9, "u", mark), (10, "u", "a" + mark * 3 + "\r\n\r\n" + mark),
        (11, "u", "ends\r\n\r\n"), (12, "u", "\r\n\r\n\r\n"), (13, "u", "a" * 500 + "\r\n\r\nWARC-Type: response\r\n\r\n"), (14, "u", big + "z"), (None, "u", "y" * 2000), (2, None, "x" * 1000),
        (20, "http://a/" + "long" * 50_000, "z" * 1500), (21, "http://b\x85WARC-Type: revisit", "z" * 1500), *((30 + i, "hot", "h" * 1200) for i in range(200)),
    ]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, record_type string")
    for compression in ("gzip", "none"):
        path = warc.write_archives(frame, chunk_chars=512, compression=compression)
        got = Counter(tuple(r) for r in warc.read_records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        groups = defaultdict(list)
        for i, _, html in pages:
            groups[html or ""].append(i)
        want = Counter()
        for i, _, html in pages:
            raw = (html or "").encode()
            best = max((x for x in groups[html or ""] if x is not None), default=None)
            again = len(raw) >= 1000 and best is not None and i != best
            want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best if again else None] += 1
        assert got == want
    assert warc.read_records(spark, warc.write_archives(frame.limit(0))).count() == 0


# --- shards ---------------------------------------------------------------------------


def test_op1_versions_and_compaction(spark):
    docs, rows = corpus(spark)
    store = sharding.ShardStore(spark, storage.new_path(spark, "store"), target_bytes=200_000)
    assert store.version() == 0 and store.read().count() == 0
    for part in range(3):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(3)) == part).repartition(3))
    before = store.version()
    after = store.compact()
    assert after > before
    key = lambda frame: Counter((r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect())
    assert key(store.read()) == key(store.read(before)) == Counter((r[0], r[1]) for r in rows)
    sizes = [r["n_bytes"] for r in store.manifest().collect()]
    assert len(sizes) < store.manifest(before).count() and sum(sizes) == sum(len((r[1] or "").encode()) for r in rows)
    with pytest.raises(sharding.ConcurrentCommit):
        store.commit(store.manifest(), after, store.schema())
    store.vacuum()
    assert key(store.read()) == Counter((r[0], r[1]) for r in rows)


def plain_tier(n, target, fan_in):
    tier = 0
    while n < target / 2 / fan_in**tier:
        tier += 1
    return tier


def plain_compaction(sizes, target, fan_in):
    """Sizes of shards after merging until no tier is due."""
    sizes = list(sizes)
    while True:
        merged = []
        for tier in {plain_tier(n, target, fan_in) for n in sizes} - {0}:
            mine = sorted(n for n in sizes if plain_tier(n, target, fan_in) == tier)
            if len(mine) < fan_in:
                continue
            groups, total = defaultdict(list), 0
            for n in mine:
                total += n
                groups[(total - 1) // target].append(n)
            merged += [g for g in groups.values() if len(g) >= fan_in or len(g) > 1 and sum(g) >= target / 2]
        if not merged:
            return sorted(sizes)
        for g in merged:
            for n in g:
                sizes.remove(n)
            sizes.append(sum(g))


def test_op1_merges_what_the_tiers_ask(spark):
    """Two similar shards wait for more; sizes after compaction are those of the plain version."""
    store = sharding.ShardStore(spark, storage.new_path(spark, "store"), target_bytes=4000, fan_in=4)
    r = random.Random(5)
    appended = []
    for sizes in ([200, 200], [1900, 10, 12], [60, 61, 900, 1100], [r.randint(1, 700) for _ in range(9)]):
        rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
        store.append(rows.repartitionByRange(len(sizes), "doc_id"))
        appended += sizes
        version = store.version()
        if len(appended) == 2:
            assert store.compact() == version  # nothing is due
    assert sorted(x["n_bytes"] for x in store.manifest().collect()) == sorted(appended)
    store.compact()
    assert sorted(x["n_bytes"] for x in store.manifest().collect()) == plain_compaction(appended, 4000, 4)
    assert store.compact() == store.version()


def test_op1_edges(spark):
    store = sharding.ShardStore(spark, storage.new_path(spark, "store"))
    names = "doc_id long, text string, shard string, tier int, version string, row string, run int"
    docs = spark.createDataFrame([(1, None, "a", 1, "v", "r", 2), (1, "", "a", 1, "v", "r", 2), (None, "t", None, None, None, None, None), (None, "t", None, None, None, None, None)], names)
    assert store.append(docs.limit(0)) == 1 and store.read().count() == 0 and store.read().columns == [*docs.columns, "_shard", "_tier", "_version"]
    store.append(docs)
    store.compact()
    assert Counter(map(tuple, store.read().select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    store.append(docs.select("doc_id", "text", F.lit(True).alias("extra")))
    assert store.read().where("extra IS NULL").count() == 4 and store.read().count() == 8
    fs, file = store._fs("versions/.dead-writer")
    fs.create(file, False).close()
    assert store.version() == 3 and store.append(docs) == 4


# --- queries and pipeline -------------------------------------------------------------


def test_queries_over_the_smallest_tables(spark):
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    for n in names:
        got = storage.staged(queries.QUERIES[n](spark, SMALL), n)
        assert got.count() > 0
        if n in queries.ORACLES:
            columns = sorted(got.columns)
            want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[n]})").fetchall()
            assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(want), n


def test_pipeline_stages_with_clashing_names_nulls_and_repeats(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in (20, 40, 60)]
    rows = [(i, f"text number {i} " + " ".join(f"a{i}b{j}" for j in range(30))) for i in range(8)] + [(None, near[0]), (None, near[1]), (5, near[2]), (1, "same TEXT"), (2, "Same text"), (2, "Same text"), (9, None), (None, ""), (10, "long " * 50_000)]
    names = ["doc_id", "text", "tail", "expected_grade", "_sha256", "_copy", "row_key", "_may", "kept", "c0"]
    docs = spark.createDataFrame([(*r, *"abcdefgh") for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = storage.staged(stage(spark, docs, SMALL), name)
        assert kept.columns == names and kept.exceptAll(docs).count() == 0
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        found = Counter((r["doc_id"], r["text"]) for r in kept.collect())
        if name == "exact_dedup":
            assert found == Counter({*rows} - {(1, "same TEXT"), (None, "")})
        if name == "near_dedup":  # repeats of id and text stay together
            assert found == Counter([r for r in rows if r not in ((None, near[0]), (None, near[1]), (2, "Same text"), (None, ""))])
    assert corpus_pipeline.STAGES[3][1](spark, docs, SMALL).select("doc_id").distinct().count() == len({r[0] for r in rows})


def test_pipeline_run(spark):
    """Every stage's decisions are in the result, which packs what they leave."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        left = storage.staged(stage(spark, left, SMALL), "left")
    got = corpus_pipeline.run(spark, SMALL).collect()
    want = packing.token_pieces(left, PATH, 0, 2048).collect()
    piece = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(piece, got)) == Counter(map(piece, want)) and 0 < left.count() < docs.count()
    ends = defaultdict(list)
    for r in got:
        ends[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in parts) <= 2048 and sorted(a for a, _ in parts) == sorted(sum(n for b, n in parts if b < a) for a, _ in parts) for parts in ends.values())


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = storage.staged(stage(spark, docs, SMALL), name)
        assert kept.columns == docs.columns
        assert kept.exceptAll(docs).count() == 0
        docs = kept
    texts = [r["text"].lower() for r in docs.collect()]
    assert len(texts) == len(set(texts))
    got = corpus_pipeline.STAGES[3][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
