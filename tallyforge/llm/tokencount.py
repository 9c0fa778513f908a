"""Token counts of whole texts: each distinct pre-token is counted once, its count joins the documents' pre-token frequencies.

Ids are never made for a text. Documents are read into runs of a bounded size; a run holds its distinct pieces once and
each of its documents as frequencies of those. The pieces of all runs meet by hash range, where equal ones are counted once
by the library; the counts join the run that asked, and a document's sum is a product of two arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, materialise, ship
from tallyforge.llm.tokens import WholeTexts, whole_texts

#: Bytes of text after which a run ends.
RUN_BYTES = 16 << 20
#: Marks that the vocabulary never joins with the letters before them.
_MARKS = b",.;:!?"
#: Hash ranges in which equal pieces of all runs meet, at most.
RANGES = 1024
_FREQUENCIES = "run long, ids array<long>, n_bytes array<long>, n_places array<int>, frequencies binary, ranges array<binary>, head binary, tail binary"
_SCHEMA = pa.schema([("run", pa.int64()), ("ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("n_places", pa.list_(pa.int32())), ("frequencies", pa.binary()), ("ranges", pa.list_(pa.binary())), ("head", pa.binary()), ("tail", pa.binary())])


def pre_tokens(piece: bytes, words: bool, added: list[bytes]) -> tuple[bytes, ...]:
    """The pre-tokens of a piece that are counted apart: plain letters in lower case and the mark behind them, else the piece as it is."""
    if not words or not piece.isascii() or any(a in piece for a in added):
        return (piece,)
    if len(piece) > 1 and piece[-1:] in _MARKS and piece[:-1].isalpha():
        return (piece[:-1].lower(), piece[-1:])
    return (piece.lower(),) if piece.isalpha() else (piece,)


def _packed(pieces: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(pieces), *map(len, pieces)], "<u4").tobytes() + b"".join(pieces))


def _unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = (4 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)])).tolist()
    return [raw[s:e] for s, e in zip(ends, ends[1:], strict=False)]


def _run(number: int, docs: list[tuple], seen: dict[bytes, int], texts: WholeTexts, n_ranges: int) -> pa.RecordBatch:
    """A run as one row: its documents' frequencies of pieces, its distinct pre-tokens by hash range, and which of them, in
    that order, make up each piece."""
    parts = [pre_tokens(p, texts.words, texts.added) for p in seen]
    ranges: list[list[bytes]] = [[] for _ in range(n_ranges)]
    for t in sorted({t for x in parts for t in x}):
        ranges[xxhash.xxh64_intdigest(t) % n_ranges].append(t)
    place = {t: i for i, t in enumerate(t for r in ranges for t in r)}
    places, counts = (np.concatenate([d[i] for d in docs]).astype("<u4").tobytes() for i in (2, 3))
    row = {
        "run": number,
        "ids": [d[0] for d in docs],
        "n_bytes": [d[1] for d in docs],
        "n_places": [len(d[2]) for d in docs],
        "frequencies": zstandard.compress(places + counts),
        "ranges": [_packed(r) if r else None for r in ranges],
        "head": zstandard.compress(np.array([place[x[0]] for x in parts], "<i4").tobytes()),
        "tail": zstandard.compress(np.array([place[x[1]] if len(x) > 1 else -1 for x in parts], "<i4").tobytes()),
    }
    return pa.RecordBatch.from_pylist([row], _SCHEMA)


def _frequencies(batches: Iterator[pa.RecordBatch], path: str, words: bool, run_bytes: int, n_ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, body) -> runs: per document the steps between the sorted places of its pieces, and how often each occurs."""
    texts = whole_texts(path, words)
    number, held = TaskContext.get().partitionId() << 32, 0
    docs: list[tuple] = []
    seen: dict[bytes, int] = {}
    for b in batches:
        for i, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            body = body.as_py()
            often = Counter(texts.split(body))
            places = np.fromiter((seen.setdefault(p, len(seen)) for p in often), np.int64, len(often))
            order = np.argsort(places)
            counts = np.fromiter(often.values(), np.int64, len(often))[order]
            docs.append((i, len(body), np.diff(places[order], prepend=0).astype("<u4"), counts.astype("<u4")))
            held += len(body)
            if held >= run_bytes:
                yield _run(number, docs, seen, texts, n_ranges)
                number, held, docs, seen = number + 1, 0, [], {}
    if docs:
        yield _run(number, docs, seen, texts, n_ranges)


def _counted(batches: Iterator[pa.RecordBatch], path: str, words: bool) -> Iterator[pa.RecordBatch]:
    """Rows (run, place, pieces) sorted by place, the range -> (run, place, counts); each distinct piece of a range is counted once."""
    texts, now = whole_texts(path, words), None
    known: dict[bytes, int] = {}
    for b in batches:
        out = []
        for place, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
            if place != now:
                now, known = place, {}
            pieces = _unpacked(blob.as_py())
            for t in pieces:
                if t not in known:
                    known[t] = texts.length(t)
            out.append(zstandard.compress(np.fromiter(map(known.__getitem__, pieces), "<u4", len(pieces)).tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["run", "place", "counts"])


def _sums(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """A run with the counts of its pre-tokens -> doc_id, n_bytes, n_tokens of its documents."""
    row = rows.to_pylist()[0]
    array = lambda blob, kind: np.frombuffer(zstandard.decompress(blob), kind).astype(np.int64)
    answered = answers.sort_by("place").column("counts").to_pylist()
    n = np.concatenate([*(array(x, "<u4") for x in answered), [0]]).astype(np.int64)  # the last, at place -1, is that of no pre-token
    piece = n[array(row["head"], "<i4")] + n[array(row["tail"], "<i4")]
    places, counts = np.split(array(row["frequencies"], "<u4"), 2)
    sums, at = [], 0
    for k in row["n_places"]:
        sums.append(int(piece[np.cumsum(places[at : at + k])] @ counts[at : at + k]))
        at += k
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(sums, pa.int64())})


def count_tokens(docs: DataFrame, path: str, words: bool, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), as the tokenizers library gives them
    for the whole text without special tokens at its ends; strings of added tokens in a text are those tokens, as is its default.

    `words`: the vocabulary drops white space and lowers case, so a piece is what stands between white space; else a piece
    keeps the space or line end before it. Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are
    each counted; a very long text is a run of its own; other columns are ignored; an empty table gives an empty result.

    A run sends each distinct pre-token once, packed by hash range, so no word is hot, however frequent."""
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ranges = min(parts, RANGES)
    runs = materialise(bodies(docs, id_col, text_col).mapInArrow(lambda it: _frequencies(it, path, words, run_bytes, n_ranges), _FREQUENCIES), "frequencies")
    asked = runs.select("run", F.posexplode("ranges").alias("place", "pieces")).filter("pieces IS NOT NULL")
    dealt = asked.repartition(parts, "place").sortWithinPartitions("place")
    answers = dealt.mapInArrow(lambda it: _counted(it, path, words), "run long, place int, counts binary")
    sums = runs.drop("ranges").groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
