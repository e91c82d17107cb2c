r"""Ranked lexical search: the k best documents for each item, by whole-number BM25.

Terms are the longest runs of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`` with A-Z lower-cased. The
score is a sum over an item's terms, repeats included, of weight times saturated frequency; all of
it is 64-bit integers but the weights' logarithm. No term lowers a score.

1. Texts are read once; each document's terms that any item asks for are stored with their
   frequencies. Document frequencies, the number of documents and their mean length come from all rows.
2. For each term its k-th highest impact over all documents is stored (tasks keep k impacts a term
   before anything is shuffled). k documents have at least that from the term alone, so the
   largest of an item's terms is a threshold below or at its k-th score.
3. The terms of an item are sorted by their highest impact; the longest start of that order whose bounds
   sum to less than the threshold is pruned: a document with none of the other terms can't be among
   the k best, not even by a tie. The other terms are joined with the stored documents (in a task,
   against the items sent to it) and give candidates; those that can reach the threshold with the
   bound of the pruned terms are scored exactly. A task's own k-th score raises its threshold.
4. The tasks' k best of each item are merged by a window that limits before it shuffles.

Items are sent to the tasks in parts of at most ``PART_BYTES`` bytes of text, one part after the
other; statistics are those of all documents whatever the parts. Terms are told apart by SipHash.

Defined cases: null and empty texts have no terms, and items without terms no rows; items and documents
that repeat are each ranked for themselves (documents of equal score and doc_id in any order); a null
doc_id comes after all others; empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm import common, text

K, PART_BYTES = 10, 8 << 20
#: Scores of documents with items that are held at once.
_CELLS = 1 << 22


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and for each text the place of its first (one more entry at the end)."""
    return text.words(column, text._sign)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = hi - lo
    upto = np.cumsum(n)
    return np.repeat(lo - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)


def best(groups: np.ndarray, keys: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """The places of the first k of each group, by group and the keys in their order."""
    order = np.lexsort((*keys[::-1], groups))
    g = groups[order]
    start = np.append(True, g[1:] != g[:-1]) if len(g) else np.zeros(0, bool)
    place = np.arange(len(g))
    return order[place - np.maximum.accumulate(np.where(start, place, 0)) < k]


def impact(tf: np.ndarray, n: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    """The saturated frequency; total: number of documents and of all their terms."""
    m = 100 - 75 + (75 * n * total[0]) // total[1]
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Items:
    """Items with terms as arrays: the sorted terms of all, and (item, term, count) by item."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        h, first = terms(pa.array(texts, pa.string()))
        some = np.flatnonzero(np.diff(first))
        self.ids = [ids[i] for i in some]
        self.terms = text.distinct(h)
        item = np.repeat(np.arange(len(texts)), np.diff(first))
        item = np.searchsorted(some, item)
        key, self.count = np.unique(item * len(self.terms) + np.searchsorted(self.terms, h), return_counts=True)
        self.item, self.term = (key // len(self.terms), key % len(self.terms)) if len(key) else (key, key)

    def prune(self, weight: np.ndarray, kth: np.ndarray, most: np.ndarray) -> None:
        """Thresholds by the terms' k-th impacts, and the split of each item's terms into asked and pruned ones."""
        live = weight[self.term] > 0
        self.item, self.term, self.count = self.item[live], self.term[live], self.count[live]
        self.weight = weight
        n = len(self.ids)
        self.threshold = np.zeros(n, np.int64)
        np.maximum.at(self.threshold, self.item, self.count * kth[self.term])
        bound = self.count * most[self.term]
        order = np.lexsort((self.term, bound, self.item))
        item, bound = self.item[order], bound[order]
        upto = np.cumsum(bound)
        start = np.searchsorted(item, np.arange(n))
        upto -= np.append(0, upto)[start][item]
        pruned = upto < self.threshold[item]
        self.rest = np.zeros(n, np.int64)
        np.add.at(self.rest, item[pruned], bound[pruned])
        asked, off = order[~pruned], order[pruned]
        asked = asked[np.argsort(self.term[asked], kind="stable")]  # by term, for the join
        self.by_term = np.searchsorted(self.term[asked], np.arange(len(self.terms) + 1))
        self.asked_item, self.asked_count = self.item[asked], self.count[asked]
        self.by_item = np.searchsorted(self.item[off], np.arange(n + 1))
        self.off_term, self.off_count = self.term[off], self.count[off]


class Best:
    """The k best documents of each item that a task has seen."""

    def __init__(self, items: Items, k: int):
        self.items, self.k = items, k
        self.least = items.threshold.copy()
        z = np.zeros(0, np.int64)
        self.item, self.score, self.doc, self.null = z, z, z, np.zeros(0, bool)
        #: Candidates that were scored exactly, for tests.
        self.scored = 0

    def see(self, doc: np.ndarray, null: np.ndarray, of: np.ndarray, term: np.ndarray, x: np.ndarray) -> None:
        """doc: ids; (of, term, x): the place of the document, the term and the saturated frequency of each entry, by document and term."""
        step = max(1, _CELLS // max(1, len(self.items.ids)))
        at = 0
        while at < len(doc):
            # Documents whose entries meet a bounded number of items; one at least.
            lo = np.searchsorted(of, at)
            hi = np.searchsorted(of, min(len(doc), at + step))
            met = np.cumsum(self.items.by_term[term[lo:hi] + 1] - self.items.by_term[term[lo:hi]])
            to = min(len(doc), at + step)
            if len(met) and met[-1] > _CELLS:
                to = max(at + 1, int(of[lo + np.searchsorted(met, _CELLS, "right")]))
                hi = np.searchsorted(of, to)
            self._see(doc[at:to], null[at:to], of[lo:hi] - at, term[lo:hi], x[lo:hi] * self.items.weight[term[lo:hi]])
            at = to

    def _see(self, doc: np.ndarray, null: np.ndarray, of: np.ndarray, term: np.ndarray, gain: np.ndarray) -> None:
        q, n = self.items, len(self.items.ids)
        lo, hi = q.by_term[term], q.by_term[term + 1]
        at = ranges(lo, hi)
        cell = np.repeat(of * n, hi - lo) + q.asked_item[at]
        # Sums of whole numbers below 2 ** 53 are exact in doubles; larger ones are summed as integers.
        worth = q.asked_count[at] * np.repeat(gain, hi - lo)
        if len(worth) and float(worth.max()) * len(worth) < 2**53:
            score = np.bincount(cell, worth, len(doc) * n).astype(np.int64)
        else:
            score = np.zeros(len(doc) * n, np.int64)
            np.add.at(score, cell, worth)
        reach = score.reshape(len(doc), n)
        cand = np.flatnonzero(((reach > 0) & (reach + q.rest >= self.least)).ravel())
        if not len(cand):
            return
        self.scored += len(cand)
        item, score = cand % n, score[cand]
        # Exact scores: what the pruned terms add.
        lo, hi = q.by_item[item], q.by_item[item + 1]
        at, own = ranges(lo, hi), np.repeat(np.arange(len(cand)), hi - lo)
        if len(at):
            key = of * len(q.terms) + term
            want = (cand // n)[own] * len(q.terms) + q.off_term[at]
            place = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[place] == want
            np.add.at(score, own[hit], q.off_count[at[hit]] * gain[place[hit]])
        good = score >= self.least[item]
        row = (cand // n)[good]
        self.item, self.score = np.append(self.item, item[good]), np.append(self.score, score[good])
        self.doc, self.null = np.append(self.doc, doc[row]), np.append(self.null, null[row])
        keep = best(self.item, (-self.score, self.null, self.doc), self.k)
        self.item, self.score, self.doc, self.null = self.item[keep], self.score[keep], self.doc[keep], self.null[keep]
        full = np.flatnonzero(np.bincount(self.item, minlength=n) == self.k)
        kth = self.score[np.searchsorted(self.item, full, "right") - 1]
        self.least[full] = np.maximum(self.least[full], kth)


def _entries(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs): of each document the number of its terms, and places and frequencies of those in the vocabulary. Stored."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            h, first = terms(batch.column("text"))
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            at = np.flatnonzero(known[place] == h)
            of = np.searchsorted(first, at, "right") - 1
            key, tf = np.unique(of * len(known) + place[at], return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(first)) * len(known)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (key % len(known), tf)]
            cols = [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(cols, kinds)], names=["doc_id", "n", "terms", "tfs"])

    return common.stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>"), "lexical-entries")


def _flat(batch: pa.RecordBatch, total: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the document, term and saturated frequency of each entry of a batch."""
    held = batch.column("terms")
    size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    of = np.repeat(np.arange(len(size)), size)
    term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "tfs"))
    return of, term, impact(tf, batch.column("n").to_numpy()[of], total)


def _highest(entries: DataFrame, sent, total: tuple[int, int], k: int) -> DataFrame:
    """(term, kth, most): each term's k-th highest saturated frequency (0 if fewer documents hold it) and the highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_x = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = np.zeros(len(sent.value.terms), np.int64)
        for batch in batches:
            _, term, x = _flat(batch, total)
            above = x > least[term]
            held_t, held_x = np.append(held_t, term[above]), np.append(held_x, x[above])
            keep = best(held_t, (-held_x,), k)
            held_t, held_x = held_t[keep], held_x[keep]
            full = np.flatnonzero(np.bincount(held_t, minlength=len(least)) == k)
            least[full] = held_x[np.searchsorted(held_t, full, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(held_t, pa.int64()), pa.array(held_x, pa.int64())], names=["term", "x"])

    few = entries.where("size(terms) > 0").mapInArrow(run, "term long, x long")
    top = few.withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("x")))).where(F.col("place") <= k)
    return top.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("place") == k, F.col("x"))), F.lit(0)).alias("kth"), F.max("x").alias("most"))


def _part(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    entries = _entries(docs, spark.sparkContext.broadcast(items.terms))
    n, words = entries.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n:
        return None
    total, size = (n, words), len(items.terms)
    # As many rows as the part has terms.
    df, kth, most = (np.zeros(size, np.int64) for _ in range(3))
    for r in entries.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r[0]] = r[1]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    sent = spark.sparkContext.broadcast(items)
    for r in _highest(entries, sent, total, k).toLocalIterator():
        kth[r[0]], most[r[0]] = r[1], r[2]
    sent.unpersist()
    items.prune(weight, weight * kth, weight * most)
    ready = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = ready.value
        top = Best(q, k)
        for batch in batches:
            ids = batch.column("doc_id")
            top.see(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), *_flat(batch, total))
        ids = pa.array(q.ids, pa.int64()).take(pa.array(top.item, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(top.item, pa.int64()), ids, pa.array(top.doc, pa.int64(), mask=top.null), pa.array(top.score, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    found = entries.where("size(terms) > 0").mapInArrow(run, "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, limit: int = PART_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents."""
    spark = docs.sparkSession
    common.ready(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    parts = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit + 1
    out = []
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        own = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        found = _part(docs, own, k) if own.ids else None
        if found is not None:
            out.append(common.stored(found, "lexical-part") if parts > 1 else found)
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    done = out[0]
    for other in out[1:]:
        done = done.unionByName(other)
    return done


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
s AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, s.n),
q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(ts) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ts FROM benchmark)) GROUP BY i, item_id, t),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * len(ts) * s.n) // s.l) AS m FROM d, s WHERE len(ts) > 0),
x AS (SELECT q.i, q.item_id, m.r, m.doc_id, sum(q.c * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
