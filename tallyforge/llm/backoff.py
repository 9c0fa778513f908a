"""Stupid-backoff scores: n-gram count tables in hash ranges, joined to the n-grams of each batch, summed per document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import bodies, in_runs, materialise, ship
from tallyforge.llm.substring import _M1, Batch, _mix, _slices, pack, unpack

#: Longest n-gram, the factor of each step back, and the count of a word that no other document has.
ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
#: Bytes of text of a run, for each hash range too, and bits of an n-gram's key.
RUN_BYTES, BITS = 8 << 20, 56
#: Words of whole documents, about, whose n-grams are in memory at once beside the run's distinct keys.
CHUNK_WORDS = 1 << 17

ASK = {"slice": pa.int32(), "batch": pa.int32(), "a": pa.binary(), "n": pa.binary(), "tokens": pa.int64()}
SAY = {"batch": pa.int32(), "slice": pa.int32(), "n": pa.binary(), "tokens": pa.int64()}
OUT = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_trigram": pa.int64(), "n_bigram": pa.int64(), "n_unigram": pa.int64(), "log_score": pa.float64()}


def _table(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(names.items(), cols, strict=True)})


class Grams:
    """N-grams of a batch, worked out by chunks of whole documents: of all of them only the sorted distinct keys are held."""

    def __init__(self, table: pa.Table) -> None:
        self.b = Batch(table, lower=True)
        self.batch = table.column("batch")[0].as_py()
        self.b.bodies = self.b.table = None
        #: per order and start: occurrences in other documents
        self.others = np.zeros((ORDER, len(self.b.wh)), np.int64)

    def chunks(self) -> Iterator[tuple[int, int]]:
        """First documents and ends of the chunks."""
        ends, d = np.cumsum(self.b.counts), 0
        while d < len(ends):
            e = max(d + 1, int(np.searchsorted(ends, self.b.first[d] + CHUNK_WORDS, "right")))
            yield d, e
            d = e

    def words(self, d: int, e: int) -> slice:
        return slice(int(self.b.first[d]), int(self.b.first[e - 1] + self.b.counts[e - 1]))

    def grams(self, order: int, d: int, e: int, chosen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams of these documents start (none across documents; only the chosen ones), and their keys."""
        at = self.words(d, e)
        owner = self.b.owner[at]
        n = max(0, len(owner) - order)
        whole = owner[:n] == owner[order : order + n]
        start = at.start + np.nonzero(whole if chosen is None else whole & chosen[at.start : at.start + n])[0]
        h = np.zeros(len(start), np.uint64)
        for j in reversed(range(order + 1)):
            h = h * np.uint64(_M1) + self.b.wh[start + j]
        return start, _mix(_mix(h) + np.uint64(order + 1)) >> np.uint64(64 - BITS)

    def distinct(self, orders: list[int], chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of these orders, in order, and how often each occurs."""
        key = np.concatenate([np.zeros(0, np.uint64), *(self.grams(k, d, e, chosen)[1] for d, e in self.chunks() for k in orders)])
        key.sort()
        at = np.nonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))[0]
        return key[at], np.diff(at, append=len(key))

    def ask(self, slices: int, told: bool, orders: list[int], chosen: np.ndarray | None = None) -> pa.Table:
        """Distinct keys with their counts, by hash range; range 0 also takes the number of words."""
        key, n = self.distinct(orders, chosen)
        cut = _slices(key, slices, BITS)
        rows = [(i, self.batch, pack(key[cut[i] : cut[i + 1]], True), pack(n[cut[i] : cut[i + 1]]), len(self.b.wh) if told and i == 0 else 0) for i in range(slices) if told and i == 0 or cut[i] < cut[i + 1]]
        return _table(ASK, rows)

    def hear(self, said: pa.Table, orders: list[int], chosen: np.ndarray | None = None) -> None:
        """Take the corpus' counts of all n-grams of these orders (of one order: of the chosen ones), less the document's own."""
        key = self.distinct(orders, chosen)[0]
        said = said.sort_by("slice")
        total = np.concatenate([np.zeros(0, np.uint64), *(unpack(x.as_py()) for x in said.column("n"))]).astype(np.int64)
        for d, e in self.chunks():
            for k in orders:
                start, part = self.grams(k, d, e, chosen)
                name, at = np.unique(part, return_inverse=True)
                _, back, own = np.unique((self.b.owner[start] - d) * max(len(name), 1) + at, return_inverse=True, return_counts=True)
                self.others[k, start] = total[np.searchsorted(key, name)][at] - own[back]

    def may_repeat(self) -> np.ndarray:
        """Trigrams that another document can have, by their starts: it then has both of their bigrams."""
        known = self.others[1] > 0
        return known & np.concatenate([known[1:], np.zeros(min(1, len(known)), bool)])


def _ask_short(table: pa.Table, slices: int) -> pa.Table:
    return Grams(table).ask(slices, True, [0, 1])


def _ask_long(table: pa.Table, said: pa.Table, slices: int) -> pa.Table:
    if not table.num_rows:
        return _table(ASK, [])
    g = Grams(table)
    g.hear(said, [0, 1])
    return g.ask(slices, False, [2], g.may_repeat())


def _say(table: pa.Table) -> pa.Table:
    """Counts over the corpus, in the order in which each batch asked; range 0 also tells the number of words."""
    keys = [unpack(x, True) for x in table.column("a").to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.zeros(len(every), np.int64)
    np.add.at(n, at, np.concatenate([unpack(x) for x in table.column("n").to_pylist()]).astype(np.int64))
    tokens = sum(table.column("tokens").to_pylist())
    ends = np.cumsum([len(x) for x in keys])
    part = [n[at[e - len(x) : e]] for x, e in zip(keys, ends.tolist(), strict=True)]
    return _table(SAY, [(b, s, pack(p), tokens) for b, s, p in zip(table.column("batch").to_pylist(), table.column("slice").to_pylist(), part, strict=True)])


def _score(table: pa.Table, said: pa.Table) -> pa.Table:
    if not table.num_rows:
        return _table(OUT, [])
    g = Grams(table)
    b = g.b
    of = lambda r: said.filter(pc.equal(said.column("round"), r))
    short = of(1)
    g.hear(short, [0, 1])
    g.hear(of(2), [2], g.may_repeat())
    corpus = short.sort_by("slice").column("tokens")[0].as_py()
    cols = [[] for _ in range(4)]
    for d, e in g.chunks():
        counts, first, at = b.counts[d:e], b.first[d:e], g.words(d, e)
        owner, n = b.owner[at] - d, at.stop - at.start
        place = np.arange(at.start, at.stop) - first[owner]
        rest = np.maximum(corpus - counts[owner], 1)
        one, two, three = g.others[:, at]
        score = np.log(np.maximum(one, UNSEEN) / rest) + np.minimum(place, 2) * math.log(BACKOFF)
        used = np.ones(n, np.int64)
        i = np.nonzero(place >= 1)[0]
        i = i[two[i - 1] > 0]
        score[i] = np.log(two[i - 1] / one[i - 1]) + (place[i] >= 2) * math.log(BACKOFF)
        used[i] = 2
        i = np.nonzero(place >= 2)[0]
        i = i[three[i - 2] > 0]
        score[i] = np.log(three[i - 2] / two[i - 2])
        used[i] = 3
        for c, k in zip(cols, (3, 2, 1), strict=False):
            c += np.bincount(owner[used == k], minlength=e - d).tolist()
        cols[3] += np.bincount(owner, weights=score, minlength=e - d).tolist()
    ids = [None if x else int(i) for x, i in zip(b.null, b.ids, strict=True)]
    return _table(OUT, list(zip(ids, b.counts.tolist(), *cols, strict=True)))


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_trigram, n_bigram, n_unigram (words scored at each order), log_score.

    Words are lower-cased in A-Z. A word's score is the share of its trigram among its bigram's occurrences in all other
    documents; without any, BACKOFF times that of its bigram; then of the word among all words. log_score sums the
    natural logarithms. The model is the whole corpus without the document itself, so that no document explains itself.

    Runs of documents and hash ranges of the count tables are sized by the text, not by the number of partitions. Each run
    sends its distinct words and bigrams with their counts to the hash ranges and gets the sums back, then likewise those
    trigrams both of whose bigrams another document has; no other trigram can be elsewhere. A run never sends more rows
    than it has keys. Keys have BITS bits. The most frequent n-gram is one entry per run. A very long text is a run of
    its own size. Null and empty texts have score 0. Null or repeated ids are documents of their own. Other columns are
    ignored; an empty table gives an empty result."""
    ship(docs.sparkSession)
    dealt, n = in_runs(bodies(docs, id_col, text_col), RUN_BYTES, "runs")
    ask = "slice int, batch int, a binary, n binary, tokens long"
    say = "batch int, slice int, n binary, tokens long"
    short = dealt.groupBy("batch").applyInArrow(lambda t: _ask_short(t, n), ask).groupBy("slice").applyInArrow(_say, say)
    short = materialise(short, "counts")
    asked = dealt.groupBy("batch").cogroup(short.groupBy("batch")).applyInArrow(lambda t, s: _ask_long(t, s, n), ask)
    long = asked.groupBy("slice").applyInArrow(_say, say)
    said = short.withColumn("round", F.lit(1)).unionByName(long.withColumn("round", F.lit(2)))
    pairs = dealt.groupBy("batch").cogroup(said.groupBy("batch"))
    return pairs.applyInArrow(_score, "doc_id long, n_words long, n_trigram long, n_bigram long, n_unigram long, log_score double")
