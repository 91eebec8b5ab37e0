"""Byte-level BPE with a hierarchical-bitmap rank queue (operator 8)."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens


class RankQueue:
    """Positions waiting under merge ranks, as numpy batches.

    Ranks are dealt in blocks of 256. A summary bitmap says which blocks hold
    entries and a bitmap of the current block which of its ranks do; find-first-set
    on one and then the other gives the next rank, however many positions
    wait. Entries for later blocks are kept unsorted and dealt to their blocks
    in bulk; a block is sorted when its turn comes.
    """

    def __init__(self, ranks: int):
        self.ranks = ranks
        self.blocks: list[list[np.ndarray]] = [[] for _ in range((ranks >> 8) + 1)]
        self.edges = np.arange(len(self.blocks) + 1, dtype=np.int64) << 40
        self.later: list[np.ndarray] = []
        self.summary = self.in_use = 0
        self.block = -1
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Add entries; those of rank -1 are no pairs and are left out."""
        entries = ((ranks << 32) | positions)[ranks >= 0]
        if not len(entries):
            return
        blocks = entries >> 40
        if blocks.min() < self.block:  # go back: what is left of this block waits again
            self.later += [(rank << 32) | p for rank, parts in self.buckets.items() for p in parts]
            self.buckets, self.in_use, self.block = {}, 0, -1
        here = blocks == self.block
        if here.any():
            self._deal(np.sort(entries[here]))
            entries = entries[~here]
        if len(entries):
            self.later.append(entries)

    def _deal(self, entries: np.ndarray) -> None:
        """Put sorted entries of the current block into its buckets."""
        ranks = entries >> 32
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[[0, *cuts]].tolist(), np.split(entries, cuts), strict=True):
            self.buckets.setdefault(rank, []).append(part & 0xFFFFFFFF)
            self.in_use |= 1 << (rank & 255)

    def next(self) -> tuple[int, np.ndarray] | None:
        """Remove the bucket of the smallest rank in use: (rank, ascending positions)."""
        if not self.in_use:
            if self.later:
                entries = np.sort(np.concatenate(self.later))
                cuts = np.searchsorted(entries, self.edges)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    self.blocks[b].append(entries[cuts[b] : cuts[b + 1]])
                    self.summary |= 1 << b
                self.later = []
            if not self.summary:
                return None
            self.block = (self.summary & -self.summary).bit_length() - 1
            self.summary &= self.summary - 1
            entries, self.blocks[self.block] = self.blocks[self.block], []
            self._deal(np.sort(np.concatenate(entries)))
        rank = (self.block << 8) + (self.in_use & -self.in_use).bit_length() - 1
        self.in_use &= self.in_use - 1
        parts = self.buckets.pop(rank)
        positions = parts[0] if len(parts) == 1 else np.sort(np.concatenate(parts))
        return rank, positions[np.concatenate(([True], positions[1:] != positions[:-1]))]


class ByteBpe:
    """Encoder and decoder for a file of ranks (token bytes in base64, rank)."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.spelled = {i: b for b, i in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        #: Stands between pre-tokens; no pair has it.
        self.gap = max(self.spelled) + 1
        pairs = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pair, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        every = np.arange(self.gap)
        #: The rank of a token's pair with itself, or -1.
        self.twice = self._rank(every, every)
        self.split = regex.compile(pattern).findall
        self.apart = regex.compile(r"\s (?!\S)").search
        self.memo = tokens.Memo(self._pieces)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the token that two neighbours would make, or -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.made[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens (as uint32 bytes): in each, always merge the pair of lowest rank, the leftmost first.

        The pre-tokens stand side by side in one linked list of parts, with
        gaps between that no pair spans, so a bucket holds the positions of its
        pair in all of them and is merged as a whole. Within a bucket positions
        ascend, and of a run of overlapping pairs every second one merges. An
        entry is stale if its position was merged away or its pair has changed
        since; it is skipped. A merge seldom makes a pair of lower rank; where
        it does, that pair comes first, so the later entries of the same
        pre-token wait in the queue again.
        """
        raw = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        ids = self.single[raw]
        ids[ends] = self.gap
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self._rank(ids[:-1], ids[1:])
        twice = self.twice
        queue = RankQueue(self.gap)
        queue.push(ranks, np.arange(n))
        while (found := queue.next()) is not None:
            rank, i = found
            i = i[ranks[i] == rank]
            if len(i) > 1:
                linked = np.concatenate(([False], after[i[:-1]] == i[1:]))
                if linked.any():
                    order = np.arange(len(i))
                    run = np.maximum.accumulate(np.where(linked, 0, order))
                    i = i[(order - run) % 2 == 0]
            elif not len(i):
                continue
            j = after[i]
            k = after[j]
            h = before[i]
            same = np.full(len(i), rank)
            near = np.stack((self._rank(ids[np.maximum(h, 0)], same), self._rank(same, ids[k])))
            near[:, 1:] = np.where(k[:-1] == i[1:], np.minimum(np.where(near[:, 1:] < 0, rank, near[:, 1:]), twice[rank] if twice[rank] >= 0 else rank), near[:, 1:])
            lower = ((near >= 0) & (near < rank)).any(axis=0)
            if lower.any() and len(i) > 1:
                word = np.searchsorted(ends, i)
                starts = np.concatenate(([True], word[1:] != word[:-1]))
                seen = np.cumsum(lower) - lower  # lower ones before this entry
                wait = seen > seen[starts][np.cumsum(starts) - 1]
                queue.push(same[wait], i[wait])
                i, j, k = i[~wait], j[~wait], k[~wait]
            ids[i], ids[j], ranks[j] = rank, -1, -1
            after[i], before[k] = k, i
            h = before[i]
            h = h[h >= 0]
            at = np.concatenate((i, h))
            ranks[at] = fresh = self._rank(ids[at], ids[after[at]])
            queue.push(fresh, at)
        left = ids >= 0
        kept = ids[left]
        cuts = np.flatnonzero(kept == self.gap)
        out = kept.astype("<u4").tobytes()
        return [out[4 * a : 4 * b] for a, b in zip([0, *(cuts[:-1] + 1).tolist()], cuts.tolist(), strict=True)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces between cuts, by way of their distinct pre-tokens."""
        parts = []
        for piece in pieces:
            body = piece[1:] if piece[:1] == " " else piece
            if body.isalpha():
                parts.append((piece,))  # a space and letters are a single pre-token, and so is a stop after them
            elif body[-1:] in (".", ",") and body[:-1].isalpha():
                parts.append((piece[:-1], body[-1]))
            else:
                parts.append(self.split(piece))
        words = list({w for p in parts for w in p})
        if not words:
            return [b""] * len(pieces)
        known = dict(zip(words, self.merge([w.encode() for w in words]), strict=True))
        return [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the position where each begins (and the last ends).

        Texts are cut before each space; no match of the pattern reaches from
        what isn't white space into a space, and of a run of white space the
        match leaves out the last character if something follows. Only a space
        between other white space and no word could be cut wrongly, so texts
        with such runs stay in one piece, as do those with the cutting mark.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        marked = pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0")
        mixed = pc.or_(pc.match_substring(texts, "\0"), pc.match_substring_regex(texts, r"\s \s|\s $|[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x0b]"))
        if pc.any(mixed).as_py():
            apart = np.zeros(len(texts), bool)
            for i in np.flatnonzero(mixed.to_numpy(zero_copy_only=False)).tolist():
                text = texts[i].as_py()
                apart[i] = "\0" in text or bool(self.apart(text))
            alone = pa.LargeListArray.from_arrays(pa.array(np.arange(len(texts) + 1)), texts)
            marked = pc.if_else(pa.array(apart), alone, marked.cast(alone.type))
        offsets = marked.offsets.to_numpy(zero_copy_only=False)
        ids, lengths = tokens.gather(marked.flatten(), self.memo)
        return ids, tokens.per_text(offsets - offsets[0], lengths)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The encoder for a file of ranks, loaded once in each Python worker."""
    if (ByteBpe, path, pattern) not in tokens._loaded:
        tokens._loaded[ByteBpe, path, pattern] = ByteBpe(path, pattern)
    return tokens._loaded[ByteBpe, path, pattern]


def encode_ids(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text encoded; null and empty texts have no ids."""

    def encode(batches):
        encoder = byte_bpe(ranks, pattern)
        for batch in batches:
            for part in tokens.slices(batch, "_text", tokens.QUEUE_SLICE):
                ids, starts = encoder.encode(part["_text"])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([part["doc_id"], lists], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).mapInArrow(encode, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded again in one pass.

    A null text is an empty one and has no ids; repeated rows and null ids give
    a row each; very long texts and pre-tokens are encoded whole; other
    columns, whatever their names, aren't read; an empty table has no rows.
    """

    def both(batches):
        encoder = byte_bpe(ranks, pattern)
        names = [str(i) for i in range(max(encoder.spelled) + 1)]
        for batch in batches:
            for part in tokens.slices(batch, "_text", tokens.QUEUE_SLICE):
                ids, starts = encoder.encode(part["_text"])
                rows = []
                for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = ids[a:b].tolist()
                    rows.append((b - a, hashlib.sha256(",".join(map(names.__getitem__, own)).encode()).hexdigest(), hashlib.sha256(encoder.decode(own)).hexdigest()))
                n, sha, back = zip(*rows, strict=True)
                yield pa.record_batch([part["doc_id"], pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
