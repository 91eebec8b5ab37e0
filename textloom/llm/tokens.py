"""Batch encoding of whole texts with the public tokenizers, inside Arrow tasks.

Natural text repeats its words, so a batch is split at spaces by Arrow, its
distinct pieces are encoded once, and the ids are gathered back with numpy.
Splitting at spaces is exact for both tokenizers used here; the reasons are
given at each encoder. Texts of any length are encoded whole.
"""

from __future__ import annotations

import ctypes
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
#: Pieces that one Python worker remembers at most, and their bytes with those of their values; others are worked out again.
REMEMBERED, REMEMBERED_BYTES = 800_000, 64 << 20
#: Bytes of text that a task works on at a time; its arrays take some twenty times as much.
SLICE = 1 << 21
#: The same for encoders, which ask for the ids of a slice's distinct pieces together; the rank queue gains most from large slices.
ENCODER_SLICE, QUEUE_SLICE = 1 << 23, 1 << 23


#: Byte-level vocabularies spell printable Latin-1 bytes as themselves and the other bytes as letters from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


class Memo:
    """piece -> value, say ids as little-endian uint32 bytes; the older half is forgotten when full.

    A Python worker serves tasks of different operators in turn, so only the
    memo used last keeps anything.
    """

    active: Memo | None = None

    def __init__(self, encode, size: int = REMEMBERED, size_bytes: int = REMEMBERED_BYTES):
        self.encode, self.half, self.half_bytes = encode, size // 2, size_bytes // 2
        self.new, self.old, self.held = {}, {}, 0

    def get(self, piece: str) -> bytes | None:
        ids = self.new.get(piece)
        return self.old.get(piece) if ids is None else ids

    def all(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of some distinct pieces; those not remembered are encoded together."""
        if Memo.active is not self:
            if Memo.active is not None:
                Memo.active.new, Memo.active.old, Memo.active.held = {}, {}, 0
            Memo.active = self
        found = list(map(self.new.get, pieces))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = self.old.get(pieces[i])
                if ids is None:
                    missing.append(i)
                else:
                    self.new[pieces[i]] = ids
        if missing:
            words = [pieces[i] for i in missing]
            made = self.encode(words)
            self.new.update(zip(words, made, strict=True))
            self.held += sum(map(len, words)) + sum(len(m) if isinstance(m, bytes) else 8 for m in made)
            for i, ids in zip(missing, made, strict=True):
                found[i] = ids
        if len(self.new) >= self.half or self.held >= self.half_bytes:
            self.old, self.new, self.held = self.new, {}, 0
        return found


def gather(pieces: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in order, and the number of ids of each piece."""
    if not len(pieces):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    coded = pieces.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known = memo.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
    flat = np.frombuffer(b"".join(known), "<u4")
    index = coded.indices.to_numpy(zero_copy_only=False)
    lengths = sizes[index]
    first = (np.cumsum(sizes, dtype=np.int32) - sizes)[index]
    ends = np.cumsum(lengths, dtype=np.int32)
    at = np.repeat(first - (ends - lengths), lengths) + np.arange(ends[-1], dtype=np.int32)
    return flat[at], lengths


def per_text(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids before each text and after the last, from the ids of each piece."""
    sums = np.concatenate(([0], np.cumsum(lengths)))
    return sums[offsets]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    release()


def release() -> None:
    """Give memory that freed arrays left with this Python worker back to the system; other tasks share the executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


class WordBpe:
    """The lower-casing word tokenizer of the `tokenizers` library.

    It drops white space before its merges and its other normalisation never
    looks across white space, so the pieces between spaces are independent.
    A piece of letters only is a single pre-token in composed form; for it the
    library's model is called directly, which gives the same ids with less
    overhead per piece than its full pipeline. The vocabulary's special tokens
    are found in the text as it is written, before it is lower-cased, as the
    library does; they hold no space, so they lie within a piece.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.stops = {s: self._ids(s) for s in (".", ",")}
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(lambda pieces: list(map(self._piece, pieces)), remembered, REMEMBERED_BYTES * remembered // REMEMBERED)

    def _ids(self, pre_token: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(pre_token)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        stop = self.stops.get(piece[-1:])
        if stop is not None and len(piece) > 1 and piece[:-1].isalpha():
            return (self.memo.get(piece[:-1]) or self._piece(piece[:-1])) + stop
        if not piece.isalpha():
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if piece.isascii():
            return self._ids(piece.lower())
        if "Σ" in piece or "İ" in piece or not unicodedata.is_normalized("NFC", piece):
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return self._ids(piece.lower().encode().decode("latin-1").translate(BYTE_LETTERS))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order and the position where each begins (and the last ends)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        raw = lists.flatten()
        pieces = pc.ascii_lower(raw)
        for mark in self.marks:
            if pc.any(pc.match_substring(texts, mark, ignore_case=True)).as_py():  # in whole texts, which is cheaper than in each piece, and rare; one in capitals is none, but its piece would be once lower-cased
                pieces = pc.if_else(pc.match_substring(pieces, mark), raw, pieces)
        ids, lengths = gather(pieces, self.memo)
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        return ids, per_text(offsets - offsets[0], lengths)


_loaded: dict[tuple, object] = {}


def word_bpe(path: str, remembered: int = REMEMBERED) -> WordBpe:
    """The encoder for a tokenizer file, loaded once in each Python worker, which remembers so many pieces at most."""
    if (WordBpe, path, remembered) not in _loaded:
        _loaded[WordBpe, path, remembered] = WordBpe(path, remembered)
    return _loaded[WordBpe, path, remembered]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
