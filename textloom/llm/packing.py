"""Best-fit sequence packing by bin completion over a length histogram (operator 2).

Documents are cut into pieces of at most one sequence. Only the histogram of
piece lengths, at most one row per possible length, reaches the driver, where
bin completion finds patterns: multisets of lengths that share a sequence, and
how often each is used. Pieces then take their places from their rank within
their length, computed in Spark.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .storage import free_name, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- the plan, from the histogram -----------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on a histogram: [(repeats, [(length, times), ...])].

    Bins with the same content are one entry, so the cost follows the number
    of different lengths and contents, not the number of items.
    """
    open_bins: dict[int, list[list]] = {}
    room: list[int] = []

    def put(left: int, entry: list) -> None:
        if left not in open_bins:
            open_bins[left] = []
            room.insert(bisect_right(room, left), left)
        open_bins[left].append(entry)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_right(room, length - 1)
            if at == len(room):
                each = capacity // length
                if todo >= each:
                    put(capacity - each * length, [todo // each, ((length, each),)])
                    todo %= each
                else:
                    put(capacity - todo * length, [1, ((length, todo),)])
                    todo = 0
                continue
            left = room[at]
            entry = open_bins[left].pop()
            if not open_bins[left]:
                del open_bins[left]
                room.pop(at)
            times = min(todo, left // length) if entry[0] == 1 else 1
            used = min(entry[0], todo // times)
            if entry[0] > used:
                put(left, [entry[0] - used, entry[1]])
            put(left - times * length, [used, (*entry[1], (length, times))])
            todo -= used * times
    return [(n, list(items)) for entries in open_bins.values() for n, items in entries]


Filling = tuple[tuple[int, int], ...]  # (length, times), descending by length


def fits_into(items: Filling, places: Filling) -> bool:
    """Whether first-fit decreasing puts all items into places of these sizes."""
    room = [list(p) for p in places]
    for length, times in items:
        at = 0
        while times:
            while at < len(room) and room[at][0] < length:
                at += 1
            if at == len(room):
                return False
            size, n = room[at]
            each = size // length
            full = min(n, times // each)
            last = times - full * each if full < n else 0  # in one more place, which isn't filled up
            parts = [[size - each * length, full], [size - last * length, int(last > 0)], [size, n - full - (last > 0)]]
            room[at : at + 1] = [p for p in parts if p[1]]
            times -= full * each + last
    return True


def completions(residual: int, lengths: list[int], counts: dict[int, int], most: int, steps: int) -> tuple[list[Filling], bool]:
    """Undominated fillings of `residual`, the fullest first, and whether none was left out.

    `lengths` ascend and have positive counts. Lengths are decided in
    descending order, each taken as often as it fits and then less often.
    Fillings are maximal: nothing left would fit. A filling is dominated by one
    into whose items its own can be put: wherever those items stand instead,
    its own could stand too. A branch is pruned by its waste bound, the room
    that all smaller items together would leave, if that lets an item fit that
    was passed over or is more than the waste of the worst of `most` fillings.
    At most `steps` lengths are placed. The stack has an entry for each length
    at most, however many items a filling has.
    """
    found: list[tuple[int, int, Filling]] = []
    budget, whole = steps, True
    volumes = [0, *np.cumsum([k * counts[k] for k in lengths]).tolist()]  # of the first so many lengths

    def keep(left: int, items: Filling) -> None:
        nonlocal whole
        if any(left >= w and fits_into(items, other) for w, _, other in found):
            return
        found[:] = [f for f in found if not (f[0] >= left and fits_into(f[2], items))]
        found.append((left, sum(n for _, n in items), items))
        found.sort()
        whole = whole and len(found) <= most
        del found[most:]

    def choice(below: int, left: int, items: Filling, passed: int) -> None:
        """Decide on the largest of the first `below` lengths that fits, if any; `passed` is the least length of which copies were passed over."""
        at = bisect_right(lengths, left, 0, below)
        if at:
            stack.append((at, left, items, passed, min(counts[lengths[at - 1]], left // lengths[at - 1])))
        elif left < passed:
            keep(left, items)

    stack: list[tuple[int, int, Filling, int, int]] = []
    choice(len(lengths), residual, (), residual + 1)
    while stack:
        at, left, items, passed, times = stack.pop()
        length = lengths[at - 1]
        free = left - times * length
        least = min(passed, length) if times < counts[length] else passed
        waste = free - volumes[at - 1]
        if waste >= least:
            continue  # fewer copies waste more
        if len(found) >= most and waste > found[-1][0]:
            whole = False
            continue
        if times:
            if budget <= 0:
                whole = False
                break
            budget -= 1
            stack.append((at, left, items, passed, times - 1))
        choice(at - 1, free, (*items, (length, times)) if times else items, least)
    return [f[2] for f in found], whole


@dataclass(frozen=True)
class Plan:
    """Patterns [(repeats, ((length, times), ...))] that pack a histogram into `sequences`, which are no fewer than `bound`.

    `proved` tells that no plan has fewer sequences.
    """

    patterns: list[tuple[int, list[tuple[int, int]]]]
    sequences: int
    bound: int
    proved: bool


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: the best of the volume bound and of bounds that count items over half.

    For each length s up to half: items over capacity - s share with none of s
    or more; items over half share with no other of them; what items of s to
    half don't find beside those takes room of its own.
    """
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in lengths.tolist()], np.int64)
    before = lambda x: np.concatenate(([0], np.cumsum(x)))  # noqa: E731  sums of what is shorter
    items, volume = before(n), before(n * lengths)
    best = -(-int(volume[-1]) // capacity)
    half = np.searchsorted(lengths, capacity // 2, "right")
    s = np.concatenate(([0], lengths[:half]))
    top = np.maximum(np.searchsorted(lengths, capacity - s, "right"), half)  # from here on items share with none of s or more
    large, small = items[top] - items[half], volume[half] - volume[np.searchsorted(lengths, s)]
    room = large * capacity - (volume[top] - volume[half])
    rest = np.maximum(0, -(-(small - room) // capacity))
    return max(best, int((items[-1] - items[top] + large + rest).max()))


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 5000, branch: int = 8, steps: int = 1000) -> Plan:
    """Pack a histogram by branch and bound.

    Depth first: around the largest length that is left, the undominated
    fillings are tried, the fullest first, each as often as the counts allow
    and then less often. The incumbent starts as best-fit decreasing and takes
    every better packing found; a branch is pruned when the sequences used plus
    the bound of the rest, by volume and by waste, can't beat it. The search ends at the bound of the
    whole, when it is exhausted, or after `nodes` nodes; `branch` fillings of a
    node are followed, found in `steps` steps. Where one of these three limits
    was met and the bound wasn't, `proved` is false.
    """
    counts = {int(k): int(v) for k, v in counts.items() if v > 0 and k > 0}
    incumbent = best_fit(counts, capacity)
    best = sum(n for n, _ in incumbent)
    total = sum(k * v for k, v in counts.items())
    bound = lower_bound(counts, capacity) if counts else 0
    spent, whole = 0, True

    # A frame: the counts left, their volume, the sequences used, the patterns so far (a linked list), untried fillings with their repeats.
    def frame(left: dict, volume: int, used: int, path) -> list:
        nonlocal whole
        lengths = sorted(left)
        top = lengths[-1]
        rest = {**left, top: left[top] - 1}
        found, all_of_them = completions(capacity - top, [k for k in lengths if rest[k]], rest, branch, steps)
        whole = whole and all_of_them

        def tries():
            for items in found or [()]:
                need = dict(items)
                need[top] = need.get(top, 0) + 1
                for repeats in range(min(left[k] // n for k, n in need.items()), 0, -1):
                    yield need, repeats

        return [left, volume, used, path, tries()]

    stack = [frame(counts, total, 0, None)] if counts and best > bound else []
    while stack and best > bound:
        left, volume, used, path, tries = stack[-1]
        need, repeats = next(tries, (None, 0))
        if need is None:
            stack.pop()
            continue
        if spent >= nodes:
            whole = False
            break
        spent += 1
        rest = {k: n for k, v in left.items() if (n := v - repeats * need.get(k, 0))}
        more = used + repeats
        now = volume - sum(k * n for k, n in need.items()) * repeats
        if more + -(-now // capacity) >= best or rest and more + lower_bound(rest, capacity) >= best:
            continue
        chain = ((repeats, sorted(need.items(), reverse=True)), path)
        if rest:
            stack.append(frame(rest, now, more, chain))
            continue
        best, incumbent = more, []
        while chain:
            incumbent.append(chain[0])
            chain = chain[1]
    return Plan(incumbent, best, bound, best == bound or whole)


@dataclass(frozen=True)
class Places:
    """Where the r-th piece of a length goes: entries sorted by (length, first rank)."""

    key: np.ndarray  # length * 2**44 + first rank
    times: np.ndarray  # pieces of this length in each sequence of the pattern
    sequence: np.ndarray  # first sequence of the pattern
    offset: np.ndarray  # place of the first of them within the sequence

    @staticmethod
    def of(patterns: list[tuple[int, list[tuple[int, int]]]]) -> Places:
        ranks: dict[int, int] = {}
        rows = []
        base = 0
        for repeats, items in patterns:
            offset = 0
            for length, times in items:
                first = ranks.get(length, 0)
                rows.append(((length << 44) + first, times, base, offset))
                ranks[length] = first + repeats * times
                offset += length * times
            base += repeats
        rows.sort()
        return Places(*(np.array([r[i] for r in rows], np.int64) for i in range(4)))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) + rank
        e = np.searchsorted(self.key, key, "right") - 1
        q = key - self.key[e]
        return self.sequence[e] + q // self.times[e], self.offset[e] + q % self.times[e] * length


# --- pieces and their places ----------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = 2048, text: str = "text", remembered: int = tokens.REMEMBERED, slice_bytes: int = tokens.ENCODER_SLICE) -> DataFrame:
    """Encode whole texts, append `end_id` and cut what is longer than a sequence.

    A null text counts as empty and so has the end id only; repeated rows count
    each; other columns aren't read. `remembered` bounds the pieces whose ids a
    Python worker keeps, `slice_bytes` the text it works on at a time.
    """

    def pieces(batches):
        encoder = tokens.word_bpe(tokenizer, remembered)
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in tokens.slices(batch, "_text", slice_bytes):
                ids, starts = encoder.encode(part["_text"])
                raw = memoryview(ids.astype("<u4").tobytes())
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    n = b - a + len(end) // 4
                    for k, s in enumerate(range(0, n, capacity)):
                        size = min(capacity, n - s)
                        crc = zlib.crc32(raw[4 * (a + s) : 4 * min(a + s + size, b)])
                        rows.append((i, k, s, size, zlib.crc32(end, crc) if s + size == n else crc))
                at, k, s, size, crc = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.record_batch(
                    [part["doc_id"].take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, size, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).mapInArrow(pieces, PIECES)


def pack(pieces: DataFrame, capacity: int = 2048, per_bucket: int = 65536, report: bool = False) -> DataFrame:
    """Add sequence_id and offset to pieces with `doc_id, piece, length, ids_crc32`.

    With `report`, each row also tells the number of sequences, the bound that
    no packing can be below, and whether the number is proved to be the fewest.

    Ranks within a length are counted in buckets of hashed piece keys, so a
    length that a large share of the pieces has is spread over all buckets.
    Equal rows (repeated documents) are interchangeable and take different
    places; pieces of length 0 do not occur, since they would need no place.
    Other columns are kept; where one has the name of a result, underscores
    stand before the result's. An empty table gives an empty result.
    """
    pieces = staged(pieces, "pieces")
    names = pieces.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = pieces.toDF(*inner).withColumns({f"_{c}": F.col(inner[names.index(c)]) for c in ("doc_id", "piece", "length", "ids_crc32")})
    n = pieces.count()
    buckets = max(64, -(-n // per_bucket))
    keyed = rows.withColumn("_bucket", F.pmod(F.xxhash64("_doc_id", "_piece", "_ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("_length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = bin_completion(histogram, capacity)
    places = pieces.sparkSession.sparkContext.broadcast(Places.of(plan.patterns))
    before = Window.partitionBy("_length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_bucket", "_length").orderBy("_doc_id", "_piece", "_ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["_bucket", "_length"])

    def locate(batches):
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("_length", "_rank"))
            sequence, offset = places.value.find(length, rank)
            yield pa.record_batch([*(batch[c] for c in inner), pa.array(sequence), pa.array(offset)], [*inner, "_sequence", "_offset"])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, pieces.schema, strict=True)) + ", _sequence long, _offset long"
    found = ranked.select(*inner, "_length", (F.col("_first") + F.col("_rank")).alias("_rank")).mapInArrow(locate, schema)
    found = found.toDF(*names, free_name("sequence_id", names), free_name("offset", names))
    if not report:
        return found
    told = {"n_sequences": plan.sequences, "sequences_bound": plan.bound, "proved_fewest": plan.proved}
    return found.withColumns({free_name(k, found.columns): F.lit(v) for k, v in told.items()})
