"""Benchmark decontamination: a BM25 inverted index of test items, asked by every passage.

Items are the indexed documents; every passage of a training text is a query: overlapping
windows of words that cover it all. Items fall into classes by length (powers of two, ``LEAST``
words at least), and each class is asked by windows of twice its length, so an item's passages
don't depend on other items' lengths. BM25 weights are divided by an item's score for itself,
so one threshold holds for all items: the share of the item's weight that the passage has.

All items at or above it are retrieved by block-max WAND over blocks of ``BLOCK_ITEMS`` items.
The pivot test comes in three steps, each for all passages of a batch at once: a passage is let
go if the largest weights of its words in the class stay below the threshold; a block is live for
a passage only if the block maxima of the words reach it; in live blocks, an item is a pivot only if
the block maxima of the words that it holds reach it, and only pivots are scored. Postings of other blocks are
skipped by the words' offsets for each block, not read. ``Index.read`` counts postings, for tests.

A hit counts if both the item's question and its answer overlap the passage: enough of the
runs of three words of each stand in it. The answer is what follows the last ``?``, or else
the last sentence; an item of one sentence is all question.

The index is sent to all tasks if the items have at most ``INDEX_BYTES`` bytes; else the items
are dealt into parts of that size by hash, and each text asks part after part, one part at a time
being with the tasks. Document frequencies, the number and mean length
of items are counted over all items before, so parts and one index give equal hits.

Defined cases: null or empty texts have no passage of interest and no hit; items without words
are never hit; items that repeat are each hit; rows that repeat a doc_id are each judged; an
empty table gives no row, and no item no hit; other columns are ignored or stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common, text

THRESHOLD, QUESTION, ANSWER = 0.6, 0.6, 0.5
K1, B = 1.2, 0.75
BLOCK_ITEMS, INDEX_BYTES, RUN, LEAST = 8, 32 << 20, 3, 16
#: Entries of lists that are put together at once.
_TOGETHER = 1 << 20
HIT = "array<struct<item_id: long, score: double, question: double, answer: double>>"


def split_item(t: str) -> tuple[str, str]:
    """Question and answer of an item."""
    at = t.rfind("?")
    if 0 <= at and t[at + 1 :].strip():
        return t[: at + 1], t[at + 1 :]
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", t.rstrip())]
    return (t[: ends[-1]], t[ends[-1] :]) if ends else (t, "")


def _runs(h: np.ndarray) -> np.ndarray:
    return np.unique(text.kmers(h, min(RUN, len(h)))) if len(h) else h


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = hi - lo
    upto = np.cumsum(n)
    return np.repeat(lo - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


class Class:
    """The items of one class of lengths: ``step`` words at most; lists by term of blocks with maxima, and of postings by term and block."""

    def __init__(self, step: int, items: np.ndarray, terms: int, item: np.ndarray, term: np.ndarray, weight: np.ndarray):
        """items: numbers of the class's items in the index; item (place among them), term and weight of each posting."""
        self.step, self.items, self.read = step, items, 0
        by = np.lexsort((item, term))
        self.item, self.weight = item[by], weight[by]
        self.most = np.zeros(terms)
        np.maximum.at(self.most, term, weight)
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        key = term[by] * self.blocks + self.item // BLOCK_ITEMS
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.posting = np.append(at, len(key))  # where each block's postings of a term start
        self.block, self.block_max = key[at] % self.blocks, np.maximum.reduceat(self.weight, at)
        self.start = np.searchsorted(key[at] // self.blocks, np.arange(terms + 1))  # where each term's blocks start

    def search(self, window: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, items and scores at or above the threshold; (window, term): the distinct terms of each window, by window."""
        bound = np.bincount(window, self.most[term])
        far = bound[window] >= threshold
        window, term = window[far], term[far]
        out = [], [], []
        lists = np.cumsum(self.start[term + 1] - self.start[term])
        at = 0
        while at < len(window):
            # Whole windows, as many as lists and bounds leave room for; one at least.
            end = np.searchsorted(lists, (lists[at - 1] if at else 0) + _TOGETHER, "right")
            end = min(end, np.searchsorted(window, window[at] + max(1, _TOGETHER // self.blocks)))
            end = np.searchsorted(window, window[min(end, len(window) - 1)]) if end < len(window) else len(window)
            if end <= at:
                end = np.searchsorted(window, window[at], "right")
            self._search(window[at:end], term[at:end], threshold, out)
            at = int(end)
        return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64)))

    def _search(self, window: np.ndarray, term: np.ndarray, threshold: float, out: tuple) -> None:
        base = int(window[0])
        lo, hi = self.start[term], self.start[term + 1]
        entry = _ranges(lo, hi)
        key = np.repeat((window - base) * self.blocks, hi - lo) + self.block[entry]
        bound = np.bincount(key, self.block_max[entry])
        live = bound[key] >= threshold
        entry, key = entry[live], key[live]
        if not len(key):
            return
        # Postings of live blocks only.
        lo, hi = self.posting[entry], self.posting[entry + 1]
        at = _ranges(lo, hi)
        self.read += len(at)
        pair, place = np.unique(key, return_inverse=True)
        slot = np.repeat(place * BLOCK_ITEMS, hi - lo) + self.item[at] % BLOCK_ITEMS
        pivot = np.bincount(slot, np.repeat(self.block_max[entry], hi - lo)) >= threshold
        own = pivot[slot]
        score = np.bincount(slot[own], self.weight[at[own]], len(pivot))
        hit = np.flatnonzero(score >= threshold)
        out[0].append(pair[hit // BLOCK_ITEMS] // self.blocks + base)
        out[1].append(self.items[pair[hit // BLOCK_ITEMS] % self.blocks * BLOCK_ITEMS + hit % BLOCK_ITEMS])
        out[2].append(score[hit])


class Index:
    """``whole``: number and mean length of items, the sorted terms and each term's items of the whole benchmark, if this is a part."""

    def __init__(self, ids: list[int | None], texts: list[str | None], whole: tuple | None = None):
        h, first = text.plain_words(pa.array(texts, pa.string()))
        own = [h[a:z] for a, z in zip(first[:-1], first[1:])]
        order = sorted((i for i in range(len(ids)) if len(own[i])), key=lambda i: (len(own[i]), i))  # alike lengths share a block
        self.ids = [ids[i] for i in order]
        own = [own[i] for i in order]
        parts = [split_item(texts[i]) for i in order]
        self.question, self.answer = [], []
        for held, k in ((self.question, 0), (self.answer, 1)):
            h, first = text.plain_words(pa.array([p[k] for p in parts], pa.string()))
            held += [_runs(h[a:z]) for a, z in zip(first[:-1], first[1:])]
        counted = [np.unique(x, return_counts=True) for x in own]
        self.terms = np.unique(np.concatenate([t for t, _ in counted])) if own else np.zeros(0, np.uint64)
        term = np.concatenate([np.searchsorted(self.terms, t) for t, _ in counted]) if own else np.zeros(0, np.int64)
        tf = np.concatenate([c for _, c in counted]).astype(np.float64) if own else np.zeros(0)
        item = np.repeat(np.arange(len(own)), [len(t) for t, _ in counted])
        size = np.array([len(x) for x in own], dtype=np.float64)
        total, mean, often = len(own), size.mean() if len(size) else 1, np.bincount(term, minlength=len(self.terms))
        if whole is not None:
            total, mean, every, counts = whole
            often = counts[np.searchsorted(every, self.terms)]
        idf = np.log(1 + (total - often + 0.5) / (often + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / mean))
        weight /= np.bincount(item, weight, minlength=len(own))[item]
        self.item, self.term, self.weight = item, term, weight
        self.classes = []
        steps = np.array([max(LEAST, 1 << (len(x) - 1).bit_length()) for x in own], dtype=np.int64)
        for step in np.unique(steps).tolist():
            items = np.flatnonzero(steps == step)
            mine = steps[item] == step
            self.classes.append(Class(step, items, len(self.terms), item[mine] - items[0], term[mine], weight[mine]))

    @property
    def read(self) -> int:
        """Postings that searches have read so far."""
        return sum(c.read for c in self.classes)

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items at or above the threshold for one passage's distinct terms, whatever the class."""
        found = [c.search(np.zeros(len(terms), np.int64), terms, threshold) for c in self.classes]
        return sorted((int(i), float(x)) for _, items, scores in found for i, x in zip(items, scores))

    def hits(self, column: pa.Array, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> list[list[dict]]:
        """For each text its verified hits, by item."""
        top: list[dict[int, dict]] = [{} for _ in range(len(column))]
        h, first = text.plain_words(column) if self.ids and len(column) else (np.zeros(0, np.uint64), None)
        if not len(h):
            return [[] for _ in top]
        place = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        at = np.flatnonzero(self.terms[place] == h)
        place = place[at]
        n, slack = np.diff(first), 1e-9
        for c in self.classes:
            count = np.where(n > 0, np.maximum(1, -(-(n - c.step) // c.step)), 0)
            before = np.append(0, np.cumsum(count))
            doc = np.repeat(np.arange(len(n)), count)
            begin = first[doc] + (np.arange(len(doc)) - before[doc]) * c.step
            end = np.minimum(begin + 2 * c.step, first[doc + 1])
            # A known word lies in the window that starts with its own step, and in the one before.
            of = np.searchsorted(first, at, "right") - 1
            step = (at - first[of]) // c.step
            last = count[of] - 1
            one, two = np.minimum(step, last), step - 1
            both = np.flatnonzero((two >= 0) & (two < one))
            window = np.concatenate([before[of] + one, before[of[both]] + two[both]])
            term = np.concatenate([place, place[both]])
            weight = c.most[term]
            # Counting repeats of a word too, this bound lets most windows go before words are told apart.
            some = np.flatnonzero((np.bincount(window, weight) >= threshold - slack)[window] & (weight > 0))
            pair = text.distinct(window[some] * len(self.terms) + term[some])
            got = c.search(pair // len(self.terms), pair % len(self.terms), threshold - slack)
            runs: dict[int, np.ndarray] = {}
            known = -1
            for w, i, score in zip(*(x.tolist() for x in got)):
                if w != known:
                    known = w
                    runs = {k: np.unique(text.kmers(h[begin[w] : end[w]], k)) for k in range(1, RUN + 1)}
                q, s = (max(float(np.isin(own, runs[k]).mean()) if len(own) else 1.0 for k in ((RUN,) if len(own) > 1 else runs)) for own in (self.question[i], self.answer[i]))
                if q >= question and s >= answer:
                    x = {"item_id": self.ids[i], "score": score, "question": q, "answer": s}
                    held = top[doc[w]].get(i)
                    if held is None or (x["score"], x["question"], x["answer"]) > (held["score"], held["question"], held["answer"]):
                        top[doc[w]][i] = x
        return [[own[i] for i in sorted(own, key=lambda i: (self.ids[i] is None, self.ids[i] or 0, i))] for own in top]


def indexes(benchmark: DataFrame, limit: int = INDEX_BYTES) -> Iterator:
    """One index, or as many as parts of the items fit the limit, one at a time; sent to all tasks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = size // limit + 1
    whole = _statistics(items) if parts > 1 else (None, None)
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == p).collect()
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))
        ids, texts = [r["item_id"] for r in rows], [r["text"] for r in rows]
        yield spark.sparkContext.broadcast(Index(ids, texts, _of_part(whole, texts) if parts > 1 else None))


def _statistics(items: DataFrame) -> tuple[tuple, DataFrame]:
    """Number and mean length of items with words, and (t, df) of all their terms (stored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = text.plain_words(batch.column("text"))
            own = [np.unique(h[a:z]) for a, z in zip(first[:-1], first[1:]) if z > a]
            size = np.diff(first)
            terms = np.concatenate(own) if own else np.zeros(0, np.uint64)
            # A row for each term of each item, and one without a term for each item.
            size = size[size > 0]
            t = pa.concat_arrays([pa.array(terms.view(np.int64)), pa.nulls(len(size), pa.int64())])
            n = pa.concat_arrays([pa.array(np.ones(len(terms), np.int64)), pa.array(size.astype(np.int64))])
            yield pa.RecordBatch.from_arrays([t, n], names=["t", "n"])

    counted = common.stored(items.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.count("*").alias("df"), F.sum("n").alias("words")), "terms")
    one = counted.where("t is null").first()
    of = (one["df"], one["words"] / one["df"]) if one else (0, 1)
    return of, counted.where("t is not null").select("t", "df")


def _of_part(whole: tuple[tuple, DataFrame], texts: list[str | None]) -> tuple:
    """The whole benchmark's statistics with the terms of a part only, which bounds them as the part is."""
    of, counted = whole
    own = np.unique(text.plain_words(pa.array(texts, pa.string()))[0]).view(np.int64)
    spark = counted.sparkSession
    want = spark.createDataFrame(pa.table({"t": own}))
    got = counted.join(want, "t", "left_semi").toPandas()
    t = got["t"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(t)
    return (*of, t[order], got["df"].to_numpy(np.int64)[order])


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str = "hits") -> DataFrame:
    """The documents with a column of their verified hits, in place of any column of that name."""
    common.ready(docs.sparkSession)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]))

    def asker(sent):
        @F.arrow_udf(HIT)
        def ask(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for t in texts:
                yield pa.array(sent.value.hits(t), kind)

        return ask(F.col("text"))

    out, last = docs, None
    for sent in indexes(benchmark):
        if last is None:
            out = docs.withColumn(name, asker(sent))
        else:  # the parts before are done with before the next one is asked, so that tasks hold one part
            out = common.stored(out, "hits-of-parts")
            last.unpersist()
            out = out.withColumn(name, F.concat(F.col(name), asker(sent)))
        last = sent
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit."""
    name = common.free_name(docs, "hits")
    return with_hits(docs, benchmark, name).where(F.size(name) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = with_hits(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("h"))
    return hit.select("doc_id", "h.item_id", F.round("h.score", 6).alias("score"), F.round("h.question", 6).alias("question"), F.round("h.answer", 6).alias("answer"))
