"""Exact Jaccard self-join on word n-gram sets by a grouped prefix filter, and its components.

1. Shingles that many texts share are counted over all texts; they come last in the one
   order in which every set is sorted (the order is free, so counts may be coarse: a
   shingle that no task sees twice counts as rare).
2. Texts with the same prefix in that order and the same size are one group; its prefix is
   posted once. A prefix of ``n - ceil(3n/4) + 1`` shingles meets that of any linked text.
3. Round one takes, for each group, the partner that it meets under most shingles (of each
   shingle's groups, the one with the most widely shared shingles), verifies
   these pairs, and joins them to components. Round two takes every pair of groups that meet
   under a shingle, pass the size and position filters and are not yet in one component.
   So a family of thousands of near copies costs pairs in proportion to its size, and no
   pair of texts that could add a link is left out.
4. Verifying expands groups to their distinct sets and compares whole sets. Sets of one group
   that round one left apart meet under the shingles that come next after their common prefix,
   in the same way, not all with all.

Keys that many rows share are dealt out by salt (postings) or in blocks (pairs); exact copies
are one set throughout. Nothing of the corpus goes to the driver but the list of the most
frequent shingles, at most ``HEAVY`` of them.

Defined cases: a text with fewer words than the shingle has is one shingle of all its words;
null text or no words: an empty set, linked with nothing, its own component. Rows that repeat
a doc_id are each judged. A null doc_id takes part, but is no component's name unless alone.
An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common, text

#: Frequent shingles in the order at most; how often one must be seen to be frequent.
HEAVY, SEEN = 1 << 17, 12
#: Shingles counted together before rare ones are let go; entries of a block of pairs; partners in a verified block.
COUNTED, BLOCK, PARTNERS = 1 << 21, 1 << 15, 256


def _i(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def heavy_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            value, times = np.unique(np.concatenate(held), return_counts=True)
            often = times > 1
            return pa.RecordBatch.from_arrays([_i(value[often]), _i(times[often])], names=["s", "n"])

        for batch in batches:
            sets = text.shingles(batch.column("text"), k)
            held += sets
            n += sum(map(len, sets))
            if n >= COUNTED:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    rows = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "s").limit(HEAVY).toPandas()
    value = rows["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], rows["n"].to_numpy(np.int64)[order]


def _prefix_length(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    a = text.mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(keepdims=True)
    b = text.mix(s ^ np.uint64(0x9FB21C651E98DF25)).sum(keepdims=True)
    return int(text.mix(a).view(np.int64)[0]), int(text.mix(b).view(np.int64)[0])


def _ordered(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A set in the one order of all: rare shingles, then frequent ones by their counts."""
    value, times = heavy
    if not len(value) or not len(s):
        return s
    at = np.minimum(np.searchsorted(value, s), len(value) - 1)
    often = value[at] == s
    if not often.any():
        return s
    return np.concatenate([s[~often], s[often][np.argsort(times[at[often]], kind="stable")]])


FEATURES = "doc_id long, n int, s1 long, s2 long, p1 long, p2 long, prefix binary"


def features(docs: DataFrame, k: int, heavy) -> DataFrame:
    """Each document's set size, set hash, prefix hash and prefix (frequent shingles last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for s in text.shingles(batch.column("text"), k):
                n, ordered = len(s), _ordered(s, heavy.value)
                prefix = ordered[: _prefix_length(n)] if n else s
                row = (n, *_set_hash(s), *_set_hash(prefix * np.uint64(3)), prefix.astype("<u8").tobytes())
                for c, v in zip(cols, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:5]), pa.array(cols[5], pa.binary())], names=["doc_id", "n", "s1", "s2", "p1", "p2", "prefix"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FEATURES)


def postings(groups: DataFrame, heavy) -> DataFrame:
    """(token, salt, gid, n, pos) of each group's prefix; salt spreads frequent tokens over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, times = heavy.value
        for batch in batches:
            tokens, size = text.raw(batch.column("prefix"))
            token = np.frombuffer(tokens.tobytes(), "<u8")
            m = np.diff(size) // 8
            gid = np.repeat(batch.column("gid").to_numpy(), m)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(m) - m, m)
            salt, often = np.zeros(len(token), dtype=np.int64), np.zeros(len(token), dtype=bool)
            if len(value):
                at = np.minimum(np.searchsorted(value, token), len(value) - 1)
                often = value[at] == token
                salt[often] = text.mix(gid[often].astype(np.uint64)) % (times[at[often]] // 2048 + 1).astype(np.uint64)
            n = np.repeat(batch.column("n").to_numpy(), m)
            yield pa.RecordBatch.from_arrays([_i(token), pa.array(salt.astype(np.int32)), _i(gid), pa.array(n.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(often)], names=["token", "salt", "gid", "n", "pos", "often"])

    return groups.select("gid", "n", "prefix").mapInArrow(run, "token long, salt int, gid long, n int, pos int, often boolean")


def _ok(n1, p1, n2, p2) -> np.ndarray:
    """Size and position filters; positions of a pair's first common shingle always pass for a link."""
    n1, n2 = n1.astype(np.int64), n2.astype(np.int64)
    least = -(-3 * (n1 + n2) // 7)
    return (4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)) & (1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1) >= least)


def _met(posted: DataFrame) -> DataFrame:
    """Of sorted postings, those whose token some other group may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, given_head = None, False  # the first row of the run that is still open
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if head is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(head, cols)]
            token, salt, gid, n, pos, often = cols
            if not len(token):
                continue
            new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
            given = ~(new & np.append(new[1:], True)) | often
            if head is not None and given_head:
                given[0] = False
            h = int(np.flatnonzero(new)[-1])
            given_head = bool(given[h]) or (h == 0 and head is not None and given_head)
            head = [c[h : h + 1] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c[given]) for c in (token, gid, n, pos)], names=["token", "gid", "n", "pos"])

    return posted.mapInArrow(run, "token long, gid long, n int, pos int")


def _partners(entries: DataFrame) -> DataFrame:
    """(gid, head): for each group the partner it meets under most tokens, out of one for each token.

    A token's partner is the group whose tokens are, on average, the most widely shared:
    in a family of near copies, the text that the others were made from, not one of the others.
    """
    spread = entries.groupBy("token").agg(F.floor(F.log2(F.count("*")) * 64).alias("df"))
    score = entries.join(spread, "token").groupBy("gid").agg(F.floor(F.sum("df") * 4 / F.max("n")).alias("score"))
    scored = entries.join(score, "gid")
    head = scored.groupBy("token").agg(F.max(F.struct("score", (-F.col("gid")).alias("g"), F.col("n").alias("hn"), F.col("pos").alias("hp"))).alias("h")).select("token", (-F.col("h.g")).alias("head"), "h.hn", "h.hp", F.col("h.score").alias("hs"))
    met = entries.join(head, "token").where("gid <> head AND 4 * least(n, hn) >= 3 * greatest(n, hn) AND 1 + least(n - pos, hn - hp) - 1 >= ceil(3 * (n + hn) / 7)")
    votes = met.groupBy("gid", "head").agg(F.count("*").alias("v"), F.max("hs").alias("hs"))
    return votes.groupBy("gid").agg(F.max(F.struct("v", "hs", (-F.col("head")).alias("h"))).alias("best")).select("gid", (-F.col("best.h")).alias("head"))


def _pairs(entries: DataFrame) -> DataFrame:
    """(g1, g2): groups of different labels that meet under a token and pass the filters; entries: token, gid, n, pos, label."""
    span = entries.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo < hi").select("token", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("b1"), F.greatest("own", j).alias("b2")))
    dealt = entries.join(span, "token").withColumn("own", own).withColumn("b", F.explode(met)).select("token", "b.b1", "b.b2", "own", "gid", "n", "pos", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cols):
            token, b1, b2, own, gid, n, pos, label = cols
            left, shift = np.arange(len(token)), 1
            while True:
                left = left[left + shift < len(token)]
                other = left + shift
                same = (token[left] == token[other]) & (b1[left] == b1[other]) & (b2[left] == b2[other])
                left = left[same]
                if not len(left):
                    return
                other = left + shift
                good = (label[left] != label[other]) & ((b1[left] == b2[left]) | (own[left] != own[other])) & _ok(n[left], pos[left], n[other], pos[other])
                if good.any():
                    x, y = gid[left[good]], gid[other[good]]
                    once = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["g1", "g2"])
                shift += 1

        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            if not len(cols[0]):
                continue
            token, b1, b2 = cols[:3]
            new = np.append(True, (token[1:] != token[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1]))
            cut = np.flatnonzero(new)[-1]
            yield from found([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from found(held)

    return dealt.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2").mapInArrow(run, "g1 long, g2 long").distinct()


def _torn_entries(docs: DataFrame, torn: DataFrame, k: int, heavy) -> DataFrame:
    """(token, gid, n, pos, label) for sets of one group whose labels differ; torn: gid, node, label, low, s1, s2; ``gid`` of a row is the node.

    Sets of a group share their prefix and size, so two that are linked share a shingle in the
    prefix of what is left, which is as long as the shared shingles that are still needed ask for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, pos, of, size = [], [], [], []
            own = zip(text.shingles(batch.column("text"), k), *(batch.column(c).to_pylist() for c in ("s1", "s2", "gid")))
            for i, (s, s1, s2, gid) in enumerate(own):
                if _set_hash(s) != (s1, s2):  # another row with that doc_id
                    continue
                n = len(s)
                p = _prefix_length(n)
                m, needed = n - p, -(-6 * n // 7) - p
                rest = _ordered(s, heavy.value)[p : p + m - needed + 1]
                token.append(text.mix(rest ^ text.mix(np.array([gid]).astype(np.uint64))))
                pos.append(np.arange(len(rest), dtype=np.int32))
                of.append(np.full(len(rest), i))
                size.append(np.full(len(rest), n, dtype=np.int32))
            token, pos, of, size = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((token, np.uint64), (pos, np.int32), (of, np.int64), (size, np.int32)))
            yield pa.RecordBatch.from_arrays([_i(token), batch.column("node").take(pa.array(of)), pa.array(size), pa.array(pos), batch.column("label").take(pa.array(of))], names=["token", "gid", "n", "pos", "label"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(common.sized(torn, common.BROADCAST_KEYS), F.col("doc_id").eqNullSafe(F.col("low")))
    return own.select("text", "s1", "s2", "gid", "node", "label").mapInArrow(run, "token long, gid long, n int, pos int, label long").distinct()


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(a, b): the pairs of set classes whose Jaccard similarity is 3/4 or more, on whole sets; stored.

    Each class of a pair sends the text of one of its documents, once for every block of
    partners, to where the pair is compared; texts take less room than sets on the way.
    """
    pairs = common.stored(pairs, "pairs")
    size = common.stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks")), "pair-blocks")
    dealt = common.stored(common.salted_join(pairs, size, "a", "b").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")), "dealt-pairs")
    hubs = dealt.select("a", "block").distinct().select(F.col("a").alias("node"), "a", "block", F.lit(None).cast("long").alias("b"))
    sent = hubs.unionByName(dealt.select(F.col("b").alias("node"), "a", "block", "b"))
    wanted = common.stored(sent.join(classes, "node").select("low", "s1", "s2", "a", "block", "b"), "wanted")
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(common.sized(wanted, common.BROADCAST_KEYS), F.col("doc_id").eqNullSafe(F.col("low")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a_, b_ = [], []
            for a, b, s1, s2, s in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s1", "s2")), text.shingles(batch.column("text"), k)):
                if _set_hash(s) != (s1, s2):  # another row with that doc_id
                    continue
                if b is None:
                    hub, mine = a, s
                    continue
                if a != hub:
                    raise ValueError("a pair's first set is missing")
                small, large = (s, mine) if len(s) < len(mine) else (mine, s)
                shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                if 100 * shared >= 75 * (len(s) + len(mine) - shared):
                    a_.append(a)
                    b_.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(b_, pa.int64())], names=["a", "b"])

    met = joined.select("a", "block", "b", "s1", "s2", "text").repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    out = common.stored(met.mapInArrow(compare, "a long, b long").distinct(), "links")
    common.discard(pairs, size, dealt, wanted)
    del joined, met
    common.release(docs.sparkSession)
    return out


def _components(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, s1, s2) of every row, and (n, s1, s2, component_id, c) of every distinct set; ``c`` is the component's own key."""
    spark = docs.sparkSession
    common.ready(spark)
    heavy = spark.sparkContext.broadcast(heavy_shingles(docs, k))
    own = common.stored(features(docs, k, heavy), "features", "lz4")
    groups = own.where("n > 0").groupBy("n", "p1", "p2").agg(F.first("prefix").alias("prefix"))
    groups = common.stored(groups.withColumn("gid", F.monotonically_increasing_id()), "groups", "lz4")
    full, own = own, common.stored(own.drop("prefix"), "features")
    common.discard(full)
    classes = own.where("n > 0").groupBy("n", "p1", "p2", "s1", "s2").agg(F.min("doc_id").alias("low")).join(groups.select("n", "p1", "p2", "gid"), ["n", "p1", "p2"])
    classes = common.stored(classes.select("gid", "n", "s1", "s2", "low", F.monotonically_increasing_id().alias("node")), "classes")
    entries = common.stored(_met(postings(groups, heavy).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "gid")), "entries")
    common.discard(groups)

    first = classes.groupBy("gid").agg(F.min("node").alias("rep"))
    across = _partners(entries).join(first.withColumnRenamed("rep", "b"), "gid").join(first.select(F.col("gid").alias("head"), F.col("rep").alias("a")), "head").select("a", "b")
    within = classes.join(first, "gid").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = verified(docs, classes, across.unionByName(within), k)
    label = common.stored(common.components(links), "round-one")

    named = common.stored(classes.join(label, "node", "left").select("gid", "n", "s1", "s2", "low", "node", F.coalesce("component", "node").alias("label")), "named")
    group_label = named.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-1 - F.col("gid")).alias("label"))
    open_pairs = _pairs(entries.join(group_label, "gid"))
    a, b = (named.select(F.col("gid").alias(f"g{i}"), F.col("node").alias(x), F.col("label").alias(f"l{i}")) for i, x in ((1, "a"), (2, "b")))
    across = open_pairs.join(a, "g1").join(b, "g2").where("l1 <> l2").select("a", "b")
    torn = common.stored(named.join(group_label.where("label < 0").select("gid"), "gid", "left_semi"), "torn")
    if torn.isEmpty():
        within = across.where("false")
    else:
        within = _pairs(_torn_entries(docs, torn, k, heavy)).select(F.col("g1").alias("a"), F.col("g2").alias("b"))
    more = verified(docs, classes, across.unionByName(within), k)
    common.discard(entries, torn)
    last = common.stored(common.components(links.unionByName(more)), "round-two")

    # A component's name is its smallest doc_id; few rows have one that is not their class's own.
    member = classes.join(last, "node", "left").select("n", "s1", "s2", "low", F.coalesce("component", "node").alias("c"))
    name = member.groupBy("c").agg(F.min("low").alias("component_id"))
    return own, common.stored(member.join(name, "c").select("n", "s1", "s2", "component_id", "c"), "components")


def jaccard_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    own, named = _components(docs, k)
    return own.select("doc_id", "n", "s1", "s2").join(named.drop("c"), ["n", "s1", "s2"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, k: int = 5) -> DataFrame:
    """Of each component one row of least doc_id (null last), whatever other rows bear that doc_id.

    A row is told by its doc_id and its text's hash; of rows that have both alike one stays. A
    row without words stays if no other row of its doc_id does.
    """
    _, named = _components(docs, k)
    rows = common.stored(_keyed(docs, k), "rows")
    each = rows.join(named.select("n", "s1", "s2", "c"), ["n", "s1", "s2"], "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x1", "x2")).alias("m")
    best = common.stored(each.where("c is not null").groupBy("c").agg(first).select("m.doc_id", "m.x1", "m.x2"), "staying")
    bare = rows.where("n = 0").groupBy("doc_id").agg(F.min(F.struct("x1", "x2")).alias("m")).select("doc_id", "m.x1", "m.x2")
    own = best.select(F.col("doc_id").alias("_id")).distinct()
    bare = bare.join(own, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    stay = best.unionByName(bare)
    names = [F.col(c).alias(f"_{c}") for c in ("doc_id", "x1", "x2")]
    kept = stay.select(*names)
    other = rows.select("doc_id", "x1", "x2").distinct()
    gone = other.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("x1") == F.col("_x1")) & (F.col("x2") == F.col("_x2")), "left_anti")
    gone = common.sized(common.stored(gone.select(*names), "near-duplicates"), common.BROADCAST_KEYS)
    x1, x2 = _text_hashes()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_doc_id")) & (x1 == F.col("_x1")) & (x2 == F.col("_x2"))
    left = docs.join(gone, same, "left_anti")
    twice = common.stored(rows.groupBy("doc_id", "x1", "x2").count().where("count > 1").select(*names), "repeated")
    if twice.isEmpty():
        return left
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def _text_hashes() -> tuple:
    """128 bits of a text; null is a text of its own."""
    return F.xxhash64("text", F.col("text").isNull()), F.xxhash64(F.lit("second"), F.col("text"), F.col("text").isNull())


def _keyed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text hashes, and size and hash of the shingle set of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = text.shingles(batch.column("text"), k)
            both = [_set_hash(s) for s in sets]
            cols = [pa.array([len(s) for s in sets], pa.int32()), *(pa.array([b[i] for b in both], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("x1"), batch.column("x2"), *cols], names=["doc_id", "x1", "x2", "n", "s1", "s2"])

    x1, x2 = _text_hashes()
    return docs.select(F.col("doc_id").cast("long"), x1.alias("x1"), x2.alias("x2"), "text").mapInArrow(run, "doc_id long, x1 long, x2 long, n int, s1 long, s2 long")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.table(spark, sf_dir, "documents"))
