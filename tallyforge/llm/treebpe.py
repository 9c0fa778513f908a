"""Byte-level BPE by monoid tree reduction, and its decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, ship

#: Matches of up to this many bytes are leaves, merged directly.
LEAF = 12
#: Windows of more bytes are merged rank by rank, all places of a rank at once; matches (and pieces) of more aren't held.
LONG = 96
#: Distinct matches (and pieces of text) held before a cache starts anew.
HELD = 500_000


class TreeEncoder:
    """Encodes a match as a tree: halves are encoded recursively and neighbours are joined.

    The join re-encodes a window of tokens around the boundary and grows it while its outermost token changes on a side
    that has more. A token sequence is the encoding of its bytes exactly if each adjacent pair is the encoding of the
    pair's bytes (merges go by rank, and every token of the vocabulary is reached by its merges). Pairs outside the
    window are untouched, those inside come from one encoding, and the outermost tokens belong to both: so once these
    stay as they were, nothing further out can change. Joining is associative: it depends on the bytes alone."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {v: k for k, v in self.ranks.items()}
        self.none = max(self.token) + 1
        self.findall = regex.compile(pattern).findall
        self.matches: dict[bytes, list[int]] = {}
        self.pieces: dict[str, bytes] = {}
        self.sums: tuple[np.ndarray, np.ndarray] | None = None
        self.parts: dict[int, list[tuple[bytes, list[int]]]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens put together; as many as there are tokens if that is none."""
        size = self.none
        if self.sums is None:
            found = {x * size + y: r for raw, r in self.ranks.items() for i in range(1, len(raw)) if (x := self.ranks.get(raw[:i])) is not None and (y := self.ranks.get(raw[i:])) is not None}
            pairs = np.array(sorted(found), np.int64)
            self.sums = pairs, np.array([found[p] for p in pairs.tolist()], np.int64)
        pairs, ranks = self.sums
        key = a * size + b
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, ranks[at], size)

    def _by_ranks(self, raw: bytes) -> list[int] | None:
        """As leaf, for long windows: of the lowest rank, every second of overlapping places from the left at once. None
        if the outcome isn't an encoding, as some adjacent pair of it isn't one."""
        none = self.none
        ids = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)[np.frombuffer(raw, np.uint8)]
        rank = self._ranks_of(ids[:-1], ids[1:])
        while len(rank) and (low := int(rank.min())) < none:
            at = np.nonzero(rank == low)[0]
            start = np.concatenate([[True], np.diff(at) > 1])
            first = at[start][np.cumsum(start) - 1]
            at = at[(at - first) % 2 == 0]
            ids[at] = low
            gone = np.zeros(len(ids), bool)
            gone[at + 1] = True
            ids = ids[~gone]
            rank = np.concatenate([rank[~gone[1:]], [none]])[: max(len(ids) - 1, 0)]
            new = at - np.arange(len(at))  # where the merged tokens are now
            near = np.unique(np.concatenate([new - 1, new]))
            near = near[(near >= 0) & (near < len(rank))]
            rank[near] = self._ranks_of(ids[near], ids[near + 1])
        out = ids.tolist()
        for pair in set(zip(out, out[1:], strict=False)):
            if (good := self.stable.get(pair)) is None:
                if len(self.stable) >= HELD:
                    self.stable.clear()
                self.stable[pair] = good = self._one_by_one(self.token[pair[0]] + self.token[pair[1]]) == [*pair]
            if not good:
                return None
        return out

    def leaf(self, raw: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        if len(raw) > LONG and (out := self._by_ranks(raw)) is not None:
            return out
        return self._one_by_one(raw)

    def _one_by_one(self, raw: bytes) -> list[int]:
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a or b
        left, right = 1, 1
        while True:
            window = a[-left:] + b[:right]
            now = self.leaf(b"".join([self.token[t] for t in window]))
            grow_left = now[0] != a[-left] and left < len(a)
            grow_right = now[-1] != b[right - 1] and right < len(b)
            if not grow_left and not grow_right:
                return a[:-left] + now + b[right:]
            left = min(len(a), 2 * left) if grow_left else left
            right = min(len(b), 2 * right) if grow_right else right

    def tree(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF:
            return self.leaf(raw)
        half = len(raw) // 2
        if len(raw) <= LONG:
            return self.join(self.tree(raw[:half]), self.tree(raw[half:]))
        # parts of a long match often repeat: of each length the last four are held
        last = self.parts.setdefault(len(raw), [])
        for part, out in last:
            if part == raw:
                return out
        out = self.join(self.tree(raw[:half]), self.tree(raw[half:]))
        last.append((raw, out))
        del last[:-4]
        return out

    def match(self, raw: bytes) -> list[int]:
        if (out := self.matches.get(raw)) is None:
            if len(raw) > LONG:
                out = self.tree(raw)
                self.parts.clear()
                return out
            if len(self.matches) >= HELD:
                self.matches.clear()
            whole = self.ranks.get(raw)
            self.matches[raw] = out = [whole] if whole is not None else self.tree(raw)
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for piece in _cut(text):
            if (ids := self.pieces.get(piece)) is None:
                if len(self.pieces) >= HELD:
                    self.pieces.clear()
                ids = np.array([t for m in self.findall(piece) for t in self.match(m.encode())], "<u4").tobytes()
                if len(piece) <= LONG:
                    self.pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree of tokens."""
        if len(ids) <= 4096:
            return b"".join([self.token[t] for t in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


#: White space before which a text is always cut, unless white space comes before it.
_PLAIN_CUT = regex.compile(r"(?<=\S)(?=[ \n])")


def _cut(text: str) -> list[str]:
    """Pieces that no match of the pattern crosses: a match never goes on from a character that isn't white space to one
    that is, so a text is cut there; where white space comes in single spaces and line ends, by splitting alone."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith("\n\n") or not _only_plain(text):
        return _PLAIN_CUT.split(text)
    first, *rest = text.replace("\n", " \n").split(" ")
    return [first, *[x if x[:1] == "\n" else " " + x for x in rest]]


_OTHER_WHITE = (*"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0", *"                　")


def _only_plain(text: str) -> bool:
    return not any(w in text for w in _OTHER_WHITE[:10]) and (text.isascii() or not any(w in text for w in _OTHER_WHITE[10:]))


_held: dict[tuple[str, str], TreeEncoder] = {}


def tree_encoder(path: str, pattern: str) -> TreeEncoder:
    """One per Python worker."""
    if (path, pattern) not in _held:
        _held[path, pattern] = TreeEncoder(path, pattern)
    return _held[path, pattern]


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    tok = tree_encoder(path, pattern)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
    for b in batches:
        rows = []
        for doc, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = tok.encode(body.decode("utf-8", "replace"))
            back = tok.decode(np.frombuffer(ids, "<u4").tolist())
            rows.append((doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), ids if with_ids else None, back if with_ids else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded, if asked for), without a shuffle.

    Null and empty texts have no ids. A very long text is encoded match by match, a very long match as a tree. Null or repeated ids stand for their rows. Other columns are ignored; an empty
    table gives an empty result."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded binary"
    out = bodies(docs, id_col, text_col).mapInArrow(lambda it: _round_trip(it, path, pattern, with_ids), schema)
    return out if with_ids else out.select(*[F.col(c) for c in out.columns[:4]])
