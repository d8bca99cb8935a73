"""Token ids of whole texts from a public tokenizer file, one library call per distinct chunk of text.

A byte-level pre-tokenizer never joins a character that is no white space with white space behind it, nor a letter
with a punctuation mark behind it (apostrophes apart), so a text can be cut there and each chunk be encoded on its own:
the ids of the chunks, one after the other, are the ids of the text. Arrow finds the distinct chunks of a batch, a
cache keeps the ids of those used most per worker, and numpy puts the ids of the texts together.
"""

from __future__ import annotations

import ctypes
import gc
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tabsight.llm.text import MAX_SLICE, SPACES, is_space, slices, spread, string_buffers

CACHE_CHUNKS = 300_000
RESTING_CHUNKS = 30_000
JOINED = 20_000

# fixed values: lead bytes of UTF-8 sequences that can be white space; no cut behind those
_UNSURE_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
# fixed values: marks that are never part of a word, and the two of U+00C0 to U+00FF that are no letters
_MARKS = b',.;:!?)]}"'
_NO_LETTERS = (0x97, 0xB7)

# fixed values: ASCII characters that a tokenizer may take for white space
_WHITE = frozenset([*range(0x00, 0x21), 0x7F])

_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(_MARKS)] = True
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[ord("A"): ord("Z") + 1] = _IS_LETTER[ord("a"): ord("z") + 1] = True

_encoders: dict[str, "ChunkEncoder"] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, at ASCII white space behind a character that is certainly none, and at a mark
    behind what is certainly a letter."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        space = is_space(data)
        cut[1:-1] = space[1:] & ~space[:-1]
        high = np.flatnonzero(cut[1:-1] & (data[:-1] >= 0x80)) + 1  # cuts behind a sequence of several bytes
        marks = np.flatnonzero(_IS_MARK[data[1:]]) + 1
        before = data[marks - 1]
        accented = (before >= 0x80) & (before < 0xC0) & ~np.isin(before, _NO_LETTERS) & (data[np.maximum(marks - 2, 0)] == 0xC3)
        cut[marks[_IS_LETTER[before] | accented]] = True
        if len(high):
            lead = high - 1
            for _ in range(3):
                lead = np.where((data[lead] & 0xC0 == 0x80) & (lead > 0), lead - 1, lead)
            cut[high[np.isin(data[lead], _UNSURE_LEADS)]] = False
    cut[offsets] = True
    return np.flatnonzero(cut)


def _token_lengths(library) -> np.ndarray | None:
    """The bytes of each token where tokens are written with one character per byte, else nothing."""
    model = json.loads(library.to_str())
    if (model["pre_tokenizer"] or {}).get("type") != "ByteLevel" or model["pre_tokenizer"].get("add_prefix_space") or model["normalizer"]:
        return None
    out = np.zeros(library.get_vocab_size(), np.int64)
    for token, i in library.get_vocab(with_added_tokens=False).items():
        out[i] = len(token)
    for i, token in library.get_added_tokens_decoder().items():
        out[i] = len(token.content.encode())
    return out


def _joinable(chunk: bytes) -> bool:
    """White space first and certainly none last: such chunks, one after the other, are cut where they meet."""
    return chunk[0] in SPACES and (chunk[-1] < 0x80 and chunk[-1] not in _WHITE or chunk[-1] >= 0x80 and chunk[-2] == 0xC3)


class ChunkEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.lengths = _token_lengths(self.library)
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.uses = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.first = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)

    def _add(self, chunks: list[bytes]) -> None:
        gc.disable()  # many small objects that refer to nothing
        try:
            joinable = [c for c in chunks if _joinable(c)] if self.lengths is not None else []
            for at in range(0, len(joinable), JOINED):
                self._encode_joined(joinable[at: at + JOINED])
            rest = [c for c in chunks if c not in self.slot] if joinable else chunks
            for at in range(0, len(rest), JOINED):
                part = rest[at: at + JOINED]
                found = [e.ids for e in self.library.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)]
                counts = np.fromiter(map(len, found), np.int64, len(found))
                self._store(part, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts)
        finally:
            gc.enable()

    def _encode_joined(self, chunks: list[bytes]) -> None:
        """Encode chunks as one text; the tokens' lengths in bytes tell which are whose."""
        (found,) = self.library.encode_batch_fast([b"".join(chunks).decode()], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        stops = np.cumsum(self.lengths[ids])
        last = np.searchsorted(stops, ends)
        if len(stops) and stops[-1] == ends[-1] and (stops[last] == ends).all():  # else they are encoded one by one
            self._store(chunks, ids, np.diff(last, prepend=-1))

    def _store(self, chunks: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        total, base = len(ids), len(self.slot)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while base + len(chunks) > len(self.first):
            self.first, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count))
        self.ids[self.used: self.used + total] = ids
        self.first[base: base + len(chunks)] = self.used + np.cumsum(counts) - counts
        self.count[base: base + len(chunks)] = counts
        self.used += total
        self.slot.update(zip(chunks, range(base, base + len(chunks)), strict=True))

    def _shrink(self, size: int) -> None:
        """Keep the ``size`` chunks that were used most; their uses count half from then on.

        The chunks that stay are copied, so that the memory of the others can be given back.
        """
        keep = np.sort(np.argpartition(-self.uses, size)[:size])
        counts = self.count[keep]
        chunks = list(self.slot)
        self.slot = {bytes(bytearray(chunks[k])): i for i, k in enumerate(keep.tolist())}
        self.ids = self.ids[spread(self.first[keep], counts)]
        self.first, self.count, self.used, self.uses = np.cumsum(counts) - counts, counts, len(self.ids), self.uses[keep] // 2

    def rest(self) -> None:
        """Between tasks a worker keeps the chunks used most, and gives memory back where the C library can."""
        if len(self.slot) > RESTING_CHUNKS:
            self._shrink(RESTING_CHUNKS)
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = chunk_starts(data, offsets)
        if len(starts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [
            None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = chunks.dictionary_encode()
        raw, cuts = coded.dictionary.buffers()[2].to_pybytes(), np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1]
        distinct = [raw[a:b] for a, b in itertools.pairwise(cuts.tolist())]  # far quicker than to_pylist()
        new = [c for c in distinct if c not in self.slot]
        if new:
            self._add(new)
        slot = np.fromiter(map(self.slot.__getitem__, distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        self.uses = np.bincount(slot, minlength=len(self.slot)) + np.append(self.uses, np.zeros(len(self.slot) - len(self.uses), np.int64))
        counts = self.count[slot]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.ids[spread(self.first[slot], counts)]
        if len(self.slot) > CACHE_CHUNKS:
            self._shrink(CACHE_CHUNKS // 2)
        return ids, np.diff(ends[np.searchsorted(starts, offsets)])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """Every row's position and ids; a null or empty text has none."""
        data, offsets = string_buffers(column)
        for i, j in slices(offsets, MAX_SLICE):
            own = offsets[i: j + 1] - offsets[i]
            part = data[offsets[i]: offsets[j]]
            if j == i + 1 and len(part) > 4 * MAX_SLICE:  # one very long text: several runs of chunks, one after the other
                yield i, self._encode_long(part)
                continue
            ids, counts = self._encode(part, own)
            ends = np.cumsum(counts)
            for k in range(j - i):
                yield i + k, ids[ends[k] - counts[k]: ends[k]]

    def _encode_long(self, data: np.ndarray) -> np.ndarray:
        starts = chunk_starts(data, np.array([0, len(data)]))
        cuts = [0]
        while cuts[-1] < len(data):
            k = int(np.searchsorted(starts, cuts[-1] + MAX_SLICE, "right")) - 1
            nxt = int(starts[k])
            cuts.append(nxt if nxt > cuts[-1] else int(starts[np.searchsorted(starts, cuts[-1], "right")]))
        return np.concatenate([self._encode(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:], strict=False)])
