"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over: no token spans it. A table of all 65,536
byte pairs, made from the vocabulary, says which pairs these are. A batch of texts is one byte array; it is cut at every
such pair and at the bounds of the pre-tokenizer's pieces, both found in numpy for the whole batch. Every fragment is
encoded on its own, equal fragments once, and the ids are concatenated.

All distinct fragments of a batch are merged at once: in every round each of them merges its pair of the least rank. A
fragment over LONG bytes, which text rarely has, is merged with a heap instead, so n bytes cost n log n.

Only the definitions that this code stands for are accepted: a byte-level model with the pattern of PIECES, no
normalizer, and special tokens that are matched as they stand. Others raise ValueError.

Cases: null text encodes as the empty text, the empty text has no ids, a text that names the special token encodes it
as the library does, and bytes that form no valid UTF-8 when decoded become U+FFFD. Rows keep their multiplicity.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvina.llm.common import chunks

#: What the public pre-tokenizer's pattern knows. Pieces are runs of letters, of numbers or of other
#: characters, each with one space before it, then white space; the endings below stand alone after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Fragments of more bytes are merged one by one with a heap, which is quicker for them; the ids are the same.
LONG = 256
#: Characters that are encoded at a time.
SECTION = 1 << 19
_GAP = re.compile(r"\S(?=[ \n])")
NO_RANK = np.iinfo(np.int32).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point."""
    if not _kinds:
        of = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((of.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        table[[ord(c) for c in WHITE]] = SPACE
        _kinds.append(table)
    return _kinds[0]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points begin a piece of the pre-tokenizer; `first` marks the beginnings of texts."""
    n = len(points)
    kind = kinds()[points]
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    # The last white character before something else: a space goes with what follows, any other stands alone.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    begins[last] = True
    begins[last[points[last] == ord(" ")] + 1] = False
    mark = np.flatnonzero((points[:-1] == ord("'")) & begins[:-1] & ~first[1:])
    for ending in ENDINGS:
        size = len(ending)
        at = mark[mark + size < n]
        for k, c in enumerate(ending, 1):
            at = at[(points[at + k] == ord(c)) & ~first[at + k]]
        begins[at + 1] = False
        begins[(at + 1 + size)[at + 1 + size < n]] = True
    return begins


def sections(text: str) -> list[str]:
    """A long text in parts of at least SECTION characters, cut before white space that follows something else: there every piece ends, and nothing looks back."""
    if len(text) <= SECTION:
        return [text]
    out, at = [], 0
    while at < len(text):
        found = _GAP.search(text, at + SECTION)
        stop = found.end() if found else len(text)
        out.append(text[at:stop])
        at = stop
    return out


def accepted(spec: dict) -> None:
    """ValueError for a definition that asks for anything this encoder does not do."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is not None:
        raise ValueError("a normalizer is not supported")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("the pre-tokenizer is not the plain byte-level one")
    if model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        raise ValueError("the model has options that are not supported")
    for x in spec.get("added_tokens", []):
        if x.get("lstrip") or x.get("rstrip") or x.get("single_word"):
            raise ValueError("added tokens must be matched as they stand")


class PairRanks:
    """Ranks of pairs of ids, in a table with linear probing that numpy reads for many pairs at once."""

    BITS = 18

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.pairs = pairs
        while len(pairs) * 3 > 1 << self.BITS:
            self.BITS += 1
        self.keys, self.values = np.full(1 << self.BITS, -1, dtype=np.int64), np.full(1 << self.BITS, NO_RANK, dtype=np.int32)
        key = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        value = np.array(list(pairs.values()), dtype=np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = key[free]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
        self.values[slot] = value

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_RANK where it never merges."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], NO_RANK)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.BITS) - 1)
            there = self.keys[slot[todo]]
            hit = there == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[(there >= 0) & ~hit]
        return out


class ForcedBoundaryBPE:
    """Encoder and decoder made from the bytes of a tokenizers file."""

    def __init__(self, definition: bytes):
        spec = json.loads(definition)
        accepted(spec)
        alphabet = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        named = spec["model"]["vocab"]
        vocab = {bytes(alphabet[c] for c in token): i for token, i in named.items() if token not in self.special}
        self.made: list[int] | np.ndarray = []
        # By pair of ids: the rank of its merge. By rank: the id that the merge makes.
        pairs: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault((named[left], named[right]), rank)
            self.made.append(named[left + right])
        self.ranks = PairRanks(pairs)
        self.made = np.array(self.made, dtype=np.int32)
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], dtype=np.int32)
        # The same for pairs of bytes, by their two values.
        self.byte_ranks = self.ranks.of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256))
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        # Pairs of bytes that stand side by side inside some token; all others are certain cuts.
        self.inside = np.zeros(1 << 16, dtype=bool)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = True

    def merged(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all fragments one after another, the number of each) of fragments data[bounds[k]:bounds[k + 1]].

        In every round each fragment merges its pair of the least rank, wherever it stands, from the left. A merge makes
        only pairs of higher ranks, so this is the order of merging one by one.
        """
        size = np.diff(bounds)
        ids, owner = self.byte_ids[data], np.repeat(np.arange(len(size), dtype=np.int32), size)
        rank = np.full(len(ids), NO_RANK, dtype=np.int32)
        if len(data):
            rank[:-1] = self.byte_ranks[data[:-1].astype(np.uint16) << 8 | data[1:]]
        first = bounds[:-1][size > 0]
        rank[first[1:] - 1] = NO_RANK
        done_ids, done_owner = [], []
        while len(ids):
            many = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(rank, first)
            going = least != NO_RANK
            if not going.all():
                alive = np.repeat(going, many)
                done_ids.append(ids[~alive])
                done_owner.append(owner[~alive])
                ids, owner, rank, least, many = ids[alive], owner[alive], rank[alive], least[going], many[going]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(least, many))
            # Of places that overlap (aaa) every second one merges.
            if (np.diff(at) == 1).any():
                run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
                at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            place = at - np.arange(len(at))
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            first = np.flatnonzero(owner[1:] != owner[:-1]) + 1
            rank[place] = NO_RANK
            for left in (place, place - 1):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[owner[left] == owner[left + 1]]
                rank[left] = self.ranks.of(ids[left], ids[left + 1])
            first = np.concatenate([[0], first])
        if not done_ids:
            return np.zeros(0, dtype=np.int32), np.zeros(len(size), dtype=np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))

    def merged_long(self, fragment: bytes) -> list[int]:
        """Ids of one fragment by a heap, so that n bytes cost n log n."""
        ids = self.byte_ids[np.frombuffer(fragment, dtype=np.uint8)]
        ranks = self.ranks.of(ids[:-1], ids[1:])
        n, ids, made, get = len(ids), ids.tolist(), self.made, self.ranks.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k, r in enumerate(ranks.tolist()) if r != NO_RANK]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            j = after[k]
            # A pair that has changed since is passed over; a removed place holds -1.
            if ids[k] < 0 or j >= n or get((ids[k], ids[j])) != rank:
                continue
            ids[k], ids[j] = int(made[rank]), -1
            after[k] = after[j]
            for left, right in ((k, after[k]), (before[k], k)):
                if left >= 0 and right < n:
                    before[right] = left
                    if (new := get((ids[left], ids[right]))) is not None:
                        heappush(heap, (new, left))
        return [i for i in ids if i >= 0]

    def fragments(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All fragments in order, and for each text the number of fragments before it, with the total at the end."""
        whole = "".join(texts)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        at = np.concatenate([[0], np.cumsum(sizes)])
        if not whole:
            return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, dtype=np.int64)
        raw = whole.encode("utf-8", "surrogatepass")
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        first = np.zeros(len(points), dtype=bool)
        first[at[:-1][sizes > 0]] = True
        begins = piece_starts(points, first)
        data = np.frombuffer(raw, dtype=np.uint8)
        if len(data) > len(points):
            place = np.flatnonzero((data & 0xC0) != 0x80)
            cut = np.zeros(len(data), dtype=bool)
            cut[place[begins]] = True
            at = np.concatenate([place, [len(data)]])[at]
        else:
            cut = begins
        cut[1:] |= ~self.inside[data[:-1].astype(np.uint16) << 8 | data[1:]]
        start = np.flatnonzero(cut)
        bounds = np.append(start, len(data))
        return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]), np.searchsorted(start, at)

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, at = self.fragments(texts)
        if not len(parts):
            return np.zeros(0, dtype="<i4"), at
        distinct = parts.dictionary_encode()
        words, index = distinct.dictionary, np.asarray(distinct.indices)
        bounds = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1, offset=8 * words.offset)
        data, long = np.frombuffer(words.buffers()[2], dtype=np.uint8), np.flatnonzero(np.diff(bounds) > LONG)
        if len(long):
            # Long ones go by the heap; in the table of fragments they stand empty until then.
            short = np.ones(len(words), dtype=bool)
            short[long] = False
            size = np.where(short, np.diff(bounds), 0)
            own = np.concatenate([[0], np.cumsum(size)])
            flat, length = self.merged(data[np.repeat(bounds[:-1] - own[:-1], size) + np.arange(int(own[-1]))], own)
            found = [self.merged_long(words[int(k)].as_py()) for k in long]
            start = np.cumsum(length) - length
            flat = np.concatenate([flat, *(np.array(x, dtype=np.int32) for x in found)])
            length[long] = [len(x) for x in found]
            start[long] = len(flat) - np.cumsum(length[long][::-1])[::-1]
        else:
            flat, length = self.merged(data[bounds[0] : bounds[-1]], bounds - bounds[0])
            start = np.cumsum(length) - length
        many = length[index]
        stop = np.concatenate([[0], np.cumsum(many)])
        source = np.repeat(start[index] - stop[:-1], many)
        source += np.arange(int(stop[-1]))
        return flat.astype("<i4")[source], stop[at]

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text and the end)."""
        units: list[str] = []
        special: list[tuple[int, int]] = []
        owner: list[int] = []
        for k, t in enumerate(texts):
            parts = [t or ""]
            if t and self._special is not None and any(s in t for s in self.special):
                parts = self._special.split(t)
            for part in parts:
                if len(parts) > 1 and part in self.special:
                    special.append((len(units), self.special[part]))
                    part = ""
                for piece in sections(part):
                    units.append(piece)
                    owner.append(k)
        # Units are encoded in groups of about SECTION characters, so memory follows neither a batch nor a text.
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        group = np.cumsum(size) // SECTION
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(units)]
        done = [self._encode_plain(units[a:b]) for a, b in zip(cuts, cuts[1:])]
        flat = np.concatenate([np.zeros(0, dtype="<i4"), *(f for f, _ in done)]).astype("<i4", copy=False)
        sizes = np.concatenate([np.zeros(0, dtype=np.int64), *(np.diff(at) for _, at in done)])
        if special:
            unit = np.array([u for u, _ in special])
            flat = np.insert(flat, np.concatenate([[0], np.cumsum(sizes)])[unit], [i for _, i in special]).astype("<i4")
            sizes[unit] = 1
        total = np.bincount(np.array(owner, dtype=np.int64), weights=sizes, minlength=len(texts)).astype(np.int64) if owner else np.zeros(0, np.int64)
        return flat, np.concatenate([[0], np.cumsum(total)]).astype(np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        get = self.tokens.__getitem__
        return b"".join(map(get, ids)).decode("utf-8", errors="replace")


_loaded: dict[bytes, ForcedBoundaryBPE] = {}


def loaded(definition: bytes) -> ForcedBoundaryBPE:
    """One encoder for each worker process and definition."""
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = ForcedBoundaryBPE(definition)
    return _loaded[definition]


def definition(path: str) -> bytes:
    """The tokenizer's file, read on the driver; its size is the vocabulary's and does not follow the data."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; null and empty texts have no ids."""
    shared = df.sparkSession.sparkContext.broadcast(definition(path))
    slim = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for b in chunks(batches, "text"):
            flat, at = bpe.encode_batch(b.column(1).to_pylist())
            ids = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids)], ["id", "ids"])

    return slim.mapInArrow(run, f"id {id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """Adds column text, decoded from column ids; special tokens are kept."""
    shared = encoded.sparkSession.sparkContext.broadcast(definition(path))
    id_type = encoded.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(shared.value)
        for whole in batches:
            sizes = np.diff(np.asarray(whole.column(1).offsets)) if whole.num_rows else np.zeros(0)
            part = np.cumsum(sizes + 16) // 500_000
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                b = whole.slice(lo, hi - lo)
                ids = b.column(1)
                flat = ids.values.to_numpy(zero_copy_only=False)
                at = np.asarray(ids.offsets)
                text = pa.array([bpe.decode(flat[x:y].tolist()) for x, y in zip(at, at[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *([ids] if keep_ids else []), text], ["id", *(["ids"] if keep_ids else []), "text"])

    return encoded.mapInArrow(run, f"id {id_type}, " + "ids array<int>, " * keep_ids + "text string")
