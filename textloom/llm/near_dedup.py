"""Near-duplicate documents by consistent weighted sampling (operator 4).

Documents are weighted sets of five-word shingles: term frequency times a
saturating inverse document frequency. Improved consistent weighted sampling
draws samples that two sets share with the probability of their weighted
Jaccard similarity; bands of samples make buckets, and pairs from a bucket are
verified on their whole shingle sets. Sets of unit weight, whose weighted
similarity is the plain one, are sampled and verified beside them. Verified
links join documents to classes. A node is a distinct text (its normalised
word sequence), so copies, however many, are one node throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sift, tokens
from .storage import Scratch, staged

#: A shingle weighs in full while at most this share of the documents (or FULL_DOCS of them) has it.
FULL_SHARE, FULL_DOCS = 1 / 1024, 16
#: Smooths document frequencies, as a share of the documents; keeps large groups of near copies alike.
SMOOTH = 0.01
#: Frequent shingles that are told apart at most; the share above doubles until no more are frequent.
MOST_FREQUENT = 1 << 21
_EDGE = ".,;:!?\"'()[]{}<>|-*#&%$…«»„“”‚‘’"


# --- shingles -------------------------------------------------------------------------


def _word_hash(pieces: list[str]) -> list[int]:
    hashed = xxhash.xxh3_64_intdigest
    return [hashed(w.encode()) | 1 if (w := p.lower().strip(_EDGE)) else 0 for p in pieces]


_words = tokens.Memo(_word_hash, 400_000, 24 << 20)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts and where each text begins: pieces between white space, in lower case, without marks at their ends."""
    texts = pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), r"[\n\t\r\f\v]", " ")
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known = np.array(_words.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint64)
    flat = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.uint64)
    real = flat != 0
    sums = np.concatenate(([0], np.cumsum(real)))
    return flat[real], sums[offsets - offsets[0]]


def occurrences(words: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the shingles of each text in the order of its words.

    A text of fewer words than a shingle has one shingle of all of them; one
    without words has none.
    """
    n = np.diff(starts)
    with np.errstate(over="ignore"):
        mixed = np.zeros(len(words), np.uint64)
        short = []
        for j in range(size):
            part = words[j:]
            mixed[: len(part)] = mixed[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part
            if j < size - 1:
                at = starts[:-1][n == j + 1]  # texts of j + 1 words end here
                short.append((at, mixed[at] ^ np.uint64(0xA5A5A5A5 + j)))
        for at, value in short:
            mixed[at] = value
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    counts = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    ends = np.cumsum(counts)
    at = np.repeat(starts[:-1] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    return mixed[at], np.concatenate(([0], ends))


def shingles(words: np.ndarray, starts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, starts): the distinct shingles of each text, sorted, with their term frequency."""
    flat, cuts = occurrences(words, starts, size)
    begins = cuts[:-1]
    for a, b in zip(begins.tolist(), cuts[1:].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[begins[np.diff(cuts) > 0]] = True
    first = np.flatnonzero(new)
    return flat[first], np.diff(np.append(first, len(flat))), np.searchsorted(first, cuts)


# --- weights --------------------------------------------------------------------------


class Weights:
    """Inverse document frequency: 1 for all shingles but the listed ones, which more than `floor` documents have."""

    def __init__(self, n_docs: int, floor: float, hashes: np.ndarray, df: np.ndarray):
        order = np.argsort(hashes)
        full = np.log((1 + SMOOTH) * n_docs / (floor + SMOOTH * n_docs)) if n_docs else 1.0
        idf = np.log((1 + SMOOTH) * max(n_docs, 1) / (np.minimum(np.maximum(df, floor), max(n_docs, 1)) + SMOOTH * n_docs))
        self.hashes = hashes[order]
        self.idf = (np.maximum(idf / full, 1e-3) if full > 0 else np.ones(len(df)))[order].astype(np.float32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.ones(len(hashes), np.float32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.idf[at], np.float32(1))


def frequent_shingles(docs: DataFrame, n_docs: int, n_bytes: int, scratch: Scratch, size: int = 5, block_docs: int = 8192, block_shingles: int = 1 << 20, block_bytes: int = 1 << 28) -> tuple[float, np.ndarray, np.ndarray]:
    """(floor, shingles, df): all shingles that more than `floor` documents have, with their exact document frequency.

    A first pass over all texts finds candidates by lossy counting: a task
    leaves out what at most 1/2048 of its documents can have, so a frequency is
    at most that share of the documents too low, half of what counts as
    frequent. A second pass counts the candidates exactly. The floor
    is FULL_SHARE of the documents, so at most 2/FULL_SHARE times the average
    number of shingles of a document are candidates, whatever the number of
    documents; where documents are so long that these are more than
    MOST_FREQUENT, the floor doubles until they aren't.
    """

    def count(batches):
        held, n, total = [], 0, 0
        names, times, missed = (np.empty(0, t) for t in (np.uint64, np.int64, np.int64))  # counted so far, and what may have been left out before

        def gathered():
            flat = np.concatenate(held) if held else np.empty(0, np.uint64)
            held.clear()
            new, own = np.unique(flat, return_counts=True)
            del flat
            both = np.concatenate((names, new))
            order = np.argsort(both, kind="stable")  # a name counted before comes first, with its own gap
            both = both[order]
            first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
            sums = np.concatenate((times, own))[order]
            gaps = np.concatenate((missed, np.full(len(new), before // 4096)))[order]
            return both[first], np.add.reduceat(sums, first) if len(first) else sums, gaps[first]

        before = 0
        for batch in batches:
            for part in tokens.slices(batch, "_text"):
                held.append(shingles(*word_hashes(part["_text"]), size)[0])
                n, total = n + part.num_rows, total + len(held[-1])
                if n - before >= block_docs or total >= block_shingles:
                    names, times, missed = gathered()
                    often = times + missed > n // 4096
                    names, times, missed = names[often], times[often], missed[often]
                    before, total = n, 0
        names, times, missed = gathered()
        often = times + missed > n // 2048
        yield pa.record_batch([pa.array(names[often].view(np.int64)), pa.array(times[often])], ["shingle", "df"])

    few = docs.select("_text").coalesce(max(1, n_docs // block_docs, n_bytes // block_bytes))
    counted = few.mapInArrow(count, "shingle long, df long").groupBy("shingle").agg(F.sum("df").alias("df"))
    floor = max(n_docs * FULL_SHARE, FULL_DOCS)
    candidates = scratch.staged(counted.where(F.col("df") > floor - n_docs / 2048), "frequent")
    levels = {r["level"]: r["n"] for r in candidates.groupBy(F.greatest(F.lit(0), F.floor(F.log2(F.col("df") / floor))).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()}
    rise = 0
    while sum(n for level, n in levels.items() if level >= rise) > MOST_FREQUENT:
        rise += 1
    floor *= 2**rise
    likely = candidates.where(F.col("df") > floor - n_docs / 2048).select("shingle").toPandas()["shingle"].to_numpy(np.int64)  # bounded, see above
    names = np.sort(likely.view(np.uint64))
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def exact(batches):
        known = shared.value
        maybe = np.zeros(1 << 20, bool)
        maybe[known >> np.uint64(44)] = True
        times = np.zeros(len(known), np.int64)
        for batch in batches if len(known) else ():
            for part in tokens.slices(batch, "_text"):
                flat, cuts = occurrences(*word_hashes(part["_text"]), size)
                hit = np.flatnonzero(maybe[flat >> np.uint64(44)])
                at = np.minimum(np.searchsorted(known, flat[hit]), len(known) - 1)
                same = known[at] == flat[hit]
                text = np.searchsorted(cuts, hit[same], "right")
                times += np.bincount(np.unique(text * np.int64(len(known)) + at[same]) % len(known), minlength=len(known))
        some = np.flatnonzero(times)
        yield pa.record_batch([pa.array(some), pa.array(times[some])], ["at", "df"])

    found = docs.select("_text").mapInArrow(exact, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).where(F.col("df") > floor).toPandas()
    return floor, names[found["at"].to_numpy(np.int64)], found["df"].to_numpy(np.float64)


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of minima over sum of maxima of two sorted weighted sets; 0 for two empty ones."""
    at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    both = b[at] == a if len(b) else np.zeros(len(a), bool)
    least = np.minimum(wa[both], wb[at[both]]).sum() if len(b) else 0.0
    most = wa.sum() + wb.sum() - least
    return float(least / most) if most > 0 else 0.0


# --- consistent weighted sampling -----------------------------------------------------


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, whose CDF is 1 - (1 + x) exp(-x)."""
    u = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < u
        low, high = np.where(below, x, low), np.where(below, high, x)
    return low


_GAMMA = _gamma_quantiles()
_R, _INVERSE_R, _LN_C = _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)


def samples(hashes: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, n_samples: int, chunk: int = 1 << 16, unit: np.ndarray | None = None) -> np.ndarray:
    """Improved consistent weighted samples: a (texts, n_samples) array of 32-bit sample names.

    For each sample a shingle draws r, c from Gamma(2,1) and beta from [0,1),
    all from its hash; t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1).
    The shingle of least a is the sample, named by its hash and t. Texts without
    shingles have name 0. `unit`, an array of zeros like the result, is filled
    with the samples that the same draws give when all weights are 1.
    """
    n = len(starts) - 1
    out = np.zeros((n, n_samples), np.uint32)
    unit = np.empty_like(out) if unit is None else unit
    filled = np.flatnonzero(np.diff(starts))
    edges = [0]
    for i in range(len(filled)):  # whole texts per chunk
        if starts[filled[i] + 1] - starts[filled[edges[-1]]] > chunk and i > edges[-1]:
            edges.append(i)
    edges.append(len(filled))
    for e in range(len(edges) - 1):
        rows = filled[edges[e] : edges[e + 1]]
        if not len(rows):
            continue
        a, b = starts[rows[0]], starts[rows[-1] + 1]
        h, cuts = hashes[a:b], starts[rows] - a
        name = (h >> np.uint64(13)).astype(np.uint32)
        odd = np.flatnonzero(log_weights[a:b])  # other weights than 1
        lw, odd_name = log_weights[a:b][odd], name[odd]
        z, shifted, key, about = np.empty_like(h), np.empty_like(h), np.empty_like(h), np.empty(len(h), np.float32)
        low, high = key.view(np.uint32).reshape(-1, 2).T  # a key is ln a, in an order that whole numbers share, above the sample's name
        for k in range(n_samples):
            np.bitwise_xor(h, np.uint64((k + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF), out=z)
            z *= np.uint64(0x9E3779B97F4A7C15)
            z ^= np.right_shift(z, np.uint64(29), out=shifted)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= np.right_shift(z, np.uint64(32), out=shifted)
            r_at, beta, c_at, _ = z.view(np.uint16).reshape(-1, 4).T
            beta = beta.astype(np.float32) * np.float32(1 / 65536)
            ln_c = np.take(_LN_C, c_at)
            np.subtract(np.float32(1), beta, out=about)  # t is 0 where the weight is 1
            about *= np.take(_R, r_at)
            low[:], high[:] = name, _ordered(np.subtract(ln_c, about, out=about))
            unit[rows, k] = np.minimum.reduceat(key, cuts).astype(np.uint32)
            if len(odd):
                t = np.floor(lw * _INVERSE_R[r_at[odd]] + beta[odd])
                high[odd] = _ordered(ln_c[odd] - _R[r_at[odd]] * (t - beta[odd] + np.float32(1)))
                low[odd] = odd_name ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
                out[rows, k] = np.minimum.reduceat(key, cuts).astype(np.uint32)
            else:
                out[rows, k] = unit[rows, k]
    return out


def _ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of some 32-bit floats."""
    bits = values.view(np.uint32)
    return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))


def band_keys(names: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) 64-bit keys of bands of `rows` sample names each."""
    key = np.zeros((len(names), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = (key ^ names[:, r::rows][:, :bands].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    return key.view(np.int64)


# --- the operator ---------------------------------------------------------------------


def signatures(docs: DataFrame, weights, size: int, bands: int, rows: int, plain: bool = True) -> DataFrame:
    """doc_id, row_key, node (digest of the word sequence), keys (none for a text without words).

    Keys of all bands by weighted samples, then, if `plain`, by samples of unit
    weight: null where a band has the same, and left out if all have. Both
    kinds share the buckets of a band.
    """

    def sign(batches):
        for batch in batches:
            for part in tokens.slices(batch, "_text"):
                words, starts = word_hashes(part["_text"])
                raw = memoryview(words.tobytes())
                nodes = [xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                hashes, counts, at = shingles(words, starts, size)
                log_weights = np.log(counts * weights.value.of(hashes)).astype(np.float32)
                unit = np.zeros((len(nodes), bands * rows), np.uint32)
                keys = band_keys(samples(hashes, log_weights, at, bands * rows, unit=unit), bands, rows)
                both = np.concatenate((keys, band_keys(unit, bands, rows) if plain else keys), axis=1)
                same = np.concatenate((np.zeros(keys.shape, bool), both[:, bands:] == keys), axis=1)
                n = np.where(np.diff(at) > 0, np.where(same[:, bands:].all(axis=1), bands, 2 * bands), 0)
                given = np.arange(2 * bands) < n[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(both[given], mask=same[given]))
                yield pa.record_batch([part["doc_id"], part["row_key"], pa.array(nodes, pa.binary()), lists], ["doc_id", "row_key", "node", "keys"])

    return docs.mapInArrow(sign, "doc_id long, row_key long, node binary, keys array<long>")


def _features(texts: DataFrame, size: int) -> DataFrame:
    """node, hashes, counts of each text given."""

    def extract(batches):
        for batch in batches:
            for part in tokens.slices(batch, "_text"):
                words, starts = word_hashes(part["_text"])
                raw = memoryview(words.tobytes())
                hashes, counts, at = shingles(words, starts, size)
                flat, times = memoryview(hashes.tobytes()), memoryview(counts.astype("<u4").tobytes())
                rows = [
                    (xxhash.xxh3_128_digest(raw[8 * a : 8 * b]), flat[8 * c : 8 * d].tobytes(), times[4 * c : 4 * d].tobytes() if (counts[c:d] > 1).any() else b"")
                    for a, b, c, d in zip(starts[:-1].tolist(), starts[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)
                ]
                yield pa.record_batch([pa.array(x, pa.binary()) for x in zip(*rows, strict=True)], ["node", "hashes", "counts"])

    return texts.select("_text").mapInArrow(extract, "node binary, hashes binary, counts binary")


def _verified(pairs: DataFrame, features: DataFrame, weights, threshold: float, plain: bool = True) -> DataFrame:
    """(a, b, similarity): the pairs that are links, by weighted or, if `plain`, by plain Jaccard similarity of whole sets."""

    def check(batches):
        for batch in batches:
            keep, found = [], []
            for i in range(batch.num_rows):
                sides = []
                for s in ("a", "b"):
                    h = np.frombuffer(batch[f"hashes_{s}"][i].as_buffer(), np.uint64)
                    c = batch[f"counts_{s}"][i].as_buffer()
                    sides += [h, np.frombuffer(c, "<u4").astype(np.float32) if len(c) else np.ones(len(h), np.float32)]
                ha, ca, hb, cb = sides
                best = weighted_jaccard(ha, np.ones(len(ha)), hb, np.ones(len(hb))) if plain else 0.0
                if best < threshold:
                    best = weighted_jaccard(ha, ca * weights.value.of(ha), hb, cb * weights.value.of(hb))
                keep.append(best >= threshold)
                found.append(best)
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch["a"].filter(mask), batch["b"].filter(mask), pa.array(found, pa.float64()).filter(mask)], ["a", "b", "similarity"])

    sides = [features.select(F.col("node").alias(s), F.col("hashes").alias(f"hashes_{s}"), F.col("counts").alias(f"counts_{s}")) for s in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(check, "a binary, b binary, similarity double")


def _least_names(frames):
    """(node, root) of all links of one task, by union-find."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in frames:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    nodes = list(parent)
    yield pa.record_batch([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], ["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = 500_000) -> DataFrame:
    """(node, root) for every node of some links; nodes of one component share the root, its least name.

    Each round sends every node to the least of itself and its neighbours and
    rewrites the links between those. Names are digests, so the order is random
    and the number of links falls by a factor a round; once at most `few` are
    left, which is checked, a single task joins them.
    """
    with Scratch(links.sparkSession) as scratch:
        edges = scratch.staged(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
        roots = None
        while True:
            last = edges.count() <= few
            if last:
                to = scratch.staged(edges.coalesce(1).mapInArrow(_least_names, "node binary, root binary").withColumnRenamed("root", "to"), "parents")
            else:
                both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                to = scratch.staged(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "parents")
            if roots is None:
                roots = to.select("node", F.col("to").alias("root"))
            else:
                roots = scratch.staged(roots.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            if last:
                return staged(roots, "roots")
            moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            edges = scratch.staged(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")


def _block_links(near: list[np.ndarray], weights: np.ndarray, ids: np.ndarray, cuts: np.ndarray, roots: np.ndarray, n_left: int, threshold: float, plain: bool = True):
    """(a, b, similarity) of links that join components: of each pair of rows a < n_left, b > a, b >= n_left (any b > a if all rows are left), or none if earlier links join them.

    `ids` number the shingles of all rows, `cuts` tell where each row begins,
    `near` has the rows' numbers of shingles and sums of weights.
    """
    n, (sizes, sums) = len(roots), near
    first = 0 if n_left == n else n_left
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0)
    for a in range(n_left):
        low = max(first, a + 1)
        other = np.arange(low, n)
        weighed = np.minimum(sums[low:], sums[a]) >= threshold * (1 - 1e-9) * np.maximum(sums[low:], sums[a])
        if plain:
            weighed |= np.minimum(sizes[low:], sizes[a]) >= threshold * np.maximum(sizes[low:], sizes[a])
        other = other[weighed & (roots[low:] != roots[a])]
        if not len(other):
            continue
        own = slice(cuts[a], cuts[a + 1])
        mark[ids[own]] = weights[own]
        long = cuts[other + 1] - cuts[other]
        begins = np.cumsum(long) - long
        at = np.repeat(cuts[other] - begins, long) + np.arange(long.sum())
        met = mark[ids[at]]
        least = np.add.reduceat(np.minimum(met, weights[at]), begins)
        best = least / (sums[a] + sums[other] - least)
        if plain:
            common = np.add.reduceat((met > 0).astype(np.int64), begins)
            best = np.maximum(best, common / (sizes[a] + sizes[other] - common))
        mark[ids[own]] = 0
        for i in np.flatnonzero(best >= threshold).tolist():
            b = int(other[i])
            if roots[b] != roots[a]:
                roots[roots == roots[b]] = roots[a]
                yield a, b, float(best[i])


def _groups(batches, names: list[str]):
    """(key, table) for each run of equal `names` in sorted batches."""
    held, current = [], None
    for batch in batches:
        columns = [batch[c].to_numpy(zero_copy_only=False) for c in names]
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(new), batch.num_rows)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            key = tuple(int(c[a]) for c in columns)
            if key != current and held:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def _compared(apart: DataFrame, features: DataFrame, weights, threshold: float, block: int = 512, block_bytes: int = 1 << 22, plain: bool = True) -> DataFrame:
    """(a, b, similarity): links that join whatever rows (band, key, node, root) of one bucket and different roots are similar.

    No pair is left out but those that other links join. A bucket is cut into
    blocks of about `block` nodes (`block_bytes` of shingles), salted by the
    node; a task compares one pair of blocks after the other. A bucket of n
    nodes takes n * n / 2 comparisons at most and copies a node n / block times.
    """

    def links(key, table):
        table = table.combine_chunks()
        _, _, i, j = key
        blocks = table["block"].to_numpy()
        order = np.argsort(blocks, kind="stable")
        table, n_left = table.take(pa.array(order)), int((blocks == i).sum())
        if i != j and n_left == len(blocks):
            return [], []
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["hashes"]]
        times = [np.frombuffer(c, "<u4") if len(c := x.as_buffer()) else np.ones(len(h), "<u4") for x, h in zip(table["counts"], sets, strict=True)]
        sizes = np.array([len(h) for h in sets], np.int64)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        w = np.concatenate(times) * weights.value.of(names).astype(np.float64)[ids]
        roots = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)[1]
        return table["node"].to_pylist(), list(_block_links([sizes, np.add.reduceat(w, cuts[:-1])], w, ids, cuts, roots, n_left, threshold, plain))

    def compare(batches):
        for key, table in _groups(batches, ["band", "key", "i", "j"]):
            nodes, found = links(key, table)
            rows = [(min(nodes[a], nodes[b]), max(nodes[a], nodes[b]), s) for a, b, s in found]
            if rows:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    sized = apart.join(features.select("node", F.octet_length("hashes").alias("bytes")), "node")
    blocks = sized.groupBy("band", "key").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("bytes") / block_bytes)).cast("int").alias("blocks"))
    dealt = apart.join(blocks, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.select("band", "key", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    both = dealt.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root").join(features, "node")
    order = ["band", "key", "i", "j"]
    return both.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a binary, b binary, similarity double")


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, key, node, root) of the buckets whose nodes beside the centre, which all others were compared with, aren't of one component."""
    placed = members.where("node <> centre").select("band", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = placed.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "key")
    return placed.join(split, ["band", "key"]).select("band", "key", "node", "root")


def classes(docs: DataFrame, text: str = "text", size: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 3, plain: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, row_key (of doc_id and text), node, class_id, class_size, kept.

    Other columns of `docs` aren't read, so they may have any names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    docs = docs.withColumn("row_key", sift.row_key("doc_id", "_text"))
    with Scratch(spark) as scratch:
        n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text").cast("long")), F.lit(0))).first()
        weights = spark.sparkContext.broadcast(Weights(n_docs, *frequent_shingles(docs, n_docs, n_bytes, scratch, size)))
        signed = staged(signatures(docs, weights, size, bands, rows, plain), "signatures")
        nodes = scratch.staged(signed.where(F.size("keys") > 0).groupBy("node").agg(F.min(F.struct("doc_id", "row_key")).alias("row"), F.first("keys").alias("keys")), "nodes")
        entries = scratch.staged(nodes.select("node", "row", F.posexplode("keys").alias("band", "key")).where("key IS NOT NULL").withColumn("band", F.col("band") % bands), "bands")
        buckets = entries.groupBy("band", "key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
        members = scratch.staged(entries.join(buckets, ["band", "key"]), "buckets")

        wanted = members.select("row.doc_id", "row.row_key").distinct().withColumnRenamed("doc_id", "_id")
        texts = sift.sifted(docs, wanted, "row_key").where("_may").join(wanted, "row_key").where(F.col("doc_id").eqNullSafe(F.col("_id")))
        features = _features(texts, size).groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("counts").alias("counts"))  # rows may repeat id and text
        features = scratch.staged(features, "features", "lz4")

        pairs = members.where("centre <> node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
        links = scratch.staged(_verified(pairs, features, weights, threshold, plain), "links")
        roots = components(links)
        found = scratch.staged(_compared(_unsettled(members, roots), features, weights, threshold, plain=plain), "links")
        if not found.isEmpty():
            roots = components(links.unionByName(found))

    placed = signed.select("doc_id", "row_key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "node", "row_key"))
    found = placed.groupBy("root").agg(F.count("*").alias("class_size"), first.alias("best"))
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node")) & (F.col("row_key") == F.col("best.row_key"))
    return placed.join(found, "root").select("doc_id", "row_key", "node", F.col("best.doc_id").alias("class_id"), "class_size", kept.alias("kept"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept. Options are those of `classes`.

    A pair is a link if its weighted Jaccard similarity reaches the threshold,
    or, unless `plain` is false, that of its plain sets. class_id is the
    smallest doc_id of the class, whose row is kept. Null texts are empty; all
    texts without words are one class. Rows of null doc_id are classed by their
    text, and a class of such rows only has a null class_id; one of its texts
    is kept. Of rows that repeat id and text all have `kept` alike. An empty
    table gives an empty result; texts of any length are compared whole.

    All nodes of a bucket are compared with one centre first. Where the others
    of the bucket are then still of several components, all pairs of them that
    are apart are compared, by pairs of blocks. So every link between two nodes
    of a bucket is found or joined by other links; what sampling never puts
    into one bucket is missed, with a chance of 0.1 % at a similarity of 0.8
    and less above it. The last step grows with the square of a bucket whose
    nodes are not alike.
    """
    return classes(docs, **options).select("doc_id", "class_id", "class_size", "kept")


def without_near_copies(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with their columns as they were: one text of each class of near duplicates.

    Rows that repeat both id and text stay together; rows that only share an
    id, or have none, are judged each by its own text.
    """
    gone = staged(classes(docs, text, **options).where("NOT kept").select("row_key", F.col("doc_id").alias("_id")).distinct(), "near-copies")
    return sift.without(docs, gone, text)
