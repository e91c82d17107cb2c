"""Token-ID shards with a minimal perfect hash index, and packing by powers of two.

Shard format (one row of a Parquet table in shared storage; numbers little-endian):
``payload`` holds the raw unsigned 32-bit ids of its documents in ascending doc_id order;
``offsets`` (unsigned 64-bit, one more than documents) holds each document's place in ids;
``keys`` lists the documents' keys in that order (for listing, not for access);
``levels`` and ``bits`` hold the minimal perfect hash: per level its length and bit array,
whose rank is the slot of a key; ``slot_doc`` and ``prints`` hold, per slot, the document's
place in the shard and a 32-bit fingerprint of its key. Access to a key reads a constant
number of entries: its bit at each level until one is set, a rank, a fingerprint, two offsets.

Defined cases: null text is an empty text (its only id is the end id); null doc_id sorts
first and is a key of its own; rows that repeat a doc_id are each kept, told apart by their
number among equal keys of the shard; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import common, text, tokens

#: Ids in a shard at most, unless one document has more.
SHARD_IDS = 1 << 20
SHARD = pa.schema([("shard", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("offsets", pa.binary()), ("keys", pa.binary()), ("is_null", pa.binary()), ("levels", pa.binary()), ("bits", pa.binary()), ("slot_doc", pa.binary()), ("prints", pa.binary())])
SHARD_DDL = "shard string, low long, high long, n_docs long, n_ids long, payload binary, offsets binary, keys binary, is_null binary, levels binary, bits binary, slot_doc binary, prints binary"
_GAMMA = 2


def key_hash(keys: np.ndarray, is_null: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Of a key and its number among equal keys."""
    h = text.mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    return text.mix(h + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + is_null.astype(np.uint64) * np.uint64(0xDA942042E4DD58B5))


def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (text.mix(h + np.uint64((level + 1) * 0xA0761D6478BD642F % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels and bits: at each level, keys that meet no other there set their bit; the rest go on."""
    levels, parts, left = [], [], h
    while len(left):
        size = max(64, -(-len(left) * _GAMMA // 64) * 64)
        at = _slot(left, len(levels), size)
        met = np.bincount(at, minlength=size)
        levels.append(size)
        parts.append(met == 1)
        left = left[met[at] != 1]
        if len(levels) > 200:
            raise ValueError("two keys share a 64-bit hash")
    return np.array(levels, dtype="<u8"), np.packbits(np.concatenate(parts) if parts else np.zeros(0, bool), bitorder="little")


class Index:
    """Constant-time access to one shard's documents by key."""

    def __init__(self, row: dict):
        self.levels = np.frombuffer(row["levels"], "<u8").astype(np.int64)
        self.bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        self.rank = np.append(0, np.cumsum(self.bits, dtype=np.int64))
        self.base = np.append(0, np.cumsum(self.levels))
        self.slot_doc = np.frombuffer(row["slot_doc"], "<u4")
        self.prints = np.frombuffer(row["prints"], "<u4")
        self.offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
        self.payload = memoryview(row["payload"])

    def find(self, h: np.ndarray) -> np.ndarray:
        """The document's place in the shard, or -1 where the fingerprint says that the key isn't there."""
        out = np.full(len(h), -1, dtype=np.int64)
        left = np.arange(len(h))
        for k, size in enumerate(self.levels):
            at = self.base[k] + _slot(h[left], k, int(size))
            hit = self.bits[at] == 1
            slot = self.rank[at[hit]]
            same = self.prints[slot] == (h[left[hit]] >> np.uint64(32)).astype(np.uint32)
            out[left[hit][same]] = self.slot_doc[slot[same]]
            left = left[~hit]
        return out

    def ids(self, doc: int) -> memoryview:
        return self.payload[4 * self.offsets[doc] : 4 * self.offsets[doc + 1]]


def numbers(keys: np.ndarray, is_null: np.ndarray) -> np.ndarray:
    """Of each of the sorted keys among its equals."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.append(True, (keys[1:] != keys[:-1]) | (is_null[1:] != is_null[:-1]))
    at = np.arange(len(keys))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def make_shard(keys: np.ndarray, is_null: np.ndarray, payload: bytes, offsets: np.ndarray) -> dict:
    h = key_hash(keys, is_null, numbers(keys, is_null))
    levels, bits = build_hash(h)
    index = Index({"levels": levels, "bits": bits, "slot_doc": b"", "prints": b"", "offsets": b"", "payload": b""})
    slot = np.empty(len(h), dtype=np.int64)
    left = np.arange(len(h))
    for k, size in enumerate(index.levels):
        at = index.base[k] + _slot(h[left], k, int(size))
        hit = index.bits[at] == 1
        slot[left[hit]] = index.rank[at[hit]]
        left = left[~hit]
    slot_doc, prints = np.empty(len(h), dtype="<u4"), np.empty(len(h), dtype="<u4")
    slot_doc[slot], prints[slot] = np.arange(len(h)), h >> np.uint64(32)
    shown = keys[~is_null.astype(bool)]
    return {
        "low": int(shown[0]) if len(shown) else None, "high": int(shown[-1]) if len(shown) else None, "n_docs": len(h), "n_ids": int(offsets[-1]),
        "payload": payload, "offsets": offsets.astype("<u8").tobytes(), "keys": keys.astype("<i8").tobytes(), "is_null": is_null.astype(np.uint8).tobytes(),
        "levels": levels.tobytes(), "bits": bits.tobytes(), "slot_doc": slot_doc.tobytes(), "prints": prints.tobytes(),
    }


def _encoded(batch: pa.RecordBatch, tokenizer: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with the end id after each text, and where each text's start (one more at the end)."""
    ids, first = tokens.encoder(tokenizer).encode(batch.column("text"))
    n = batch.num_rows
    out = np.full(len(ids) + n, end_id, dtype="<u4")
    keep = np.ones(len(out), dtype=bool)
    keep[first[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, first + np.arange(n + 1)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode all documents and write the shards, in ascending doc_id order; the stored shard table.

    Texts are dealt out by ranges of doc_id once and encoded where they land; a shard never
    leaves its task but as one written row, so memory is bounded by a shard or the longest text.
    """
    common.ready(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        keys, nulls, parts, sizes, total = [], [], [], [], 0

        def flush():
            nonlocal made, total
            offsets = np.append(0, np.cumsum(sizes))
            row = make_shard(np.array(keys, dtype=np.int64), np.array(nulls, dtype=np.uint8), b"".join(parts), offsets)
            row["shard"] = f"{part:08d}-{made:08d}"
            made, total = made + 1, 0
            for x in (keys, nulls, parts, sizes):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=SHARD)

        for batch in batches:
            ids, first = _encoded(batch, tokenizer, end_id)
            for key, a, z in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                if total and total + z - a > shard_ids:
                    yield flush()
                keys.append(key or 0)
                nulls.append(key is None)
                parts.append(ids[a:z].tobytes())
                sizes.append(z - a)
                total += z - a
        if sizes:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return common.stored(ordered.mapInArrow(encode, SHARD_DDL), "token-shards")


def starts(shards: DataFrame) -> DataFrame:
    """(shard, before): ids in all shards before; summed over the narrow listing of shards alone."""
    listing = shards.select("shard", "n_ids")
    block = F.substring("shard", 1, 8)
    from pyspark.sql import Window

    by_block = listing.groupBy(block.alias("block")).agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = by_block.select("block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))  # one row for each write task
    own = Window.partitionBy(block).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listing.select("shard", block.alias("block"), F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("n")).join(blocks, "block").select("shard", (F.col("n") + F.col("base")).alias("before"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Each document of the files, found through the index of its shard: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, nulls = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["is_null"], np.uint8)
                index = Index(row)
                found = index.find(key_hash(keys, nulls, numbers(keys, nulls)))
                if (found < 0).any():
                    raise ValueError(f"shard {row['shard']}: its index doesn't hold a listed key")
                crc = [zlib.crc32(index.ids(d)) for d in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64(), mask=nulls.astype(bool)), pa.array(index.offsets[found] + row["before"], pa.int64()), pa.array(index.offsets[found + 1] - index.offsets[found], pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    common.ready(shards.sparkSession)
    return shards.join(starts(shards), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, ids): the ids of each document that has one of the keys (column doc_id); keyed access.

    Keys are routed to shards by the ranges in the listing; each shard then answers from its index.
    """
    ranges = shards.select("shard", "low", "high")
    wanted = keys.select("doc_id").where("doc_id is not null").distinct().join(ranges, F.col("doc_id").between(F.col("low"), F.col("high")))
    asked = wanted.groupBy("shard").agg(F.collect_list("doc_id").alias("asked"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index, number = Index(row), 0
                left = np.array(row["asked"], dtype=np.int64)
                while len(left):
                    found = index.find(key_hash(left, np.zeros(len(left)), np.full(len(left), number)))
                    left, found, number = left[found >= 0], found[found >= 0], number + 1
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array([np.frombuffer(index.ids(d), "<u4").tolist() for d in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.join(asked, "shard").mapInArrow(answer, "doc_id long, ids array<long>")


# Packing -----------------------------------------------------------------------------------------

LENGTH = 1024


def pieces_of(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length): as many full pieces as fit, then the binary parts of the rest, largest first."""
    out = [(s, length) for s in range(0, n - length + 1, length)]
    at = len(out) * length
    for k in range(length.bit_length() - 2, -1, -1):
        if (n - at) >> k & 1:
            out.append((at, 1 << k))
            at += 1 << k
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Pieces of power-of-two length; each fills a sequence of its own length alone.

    Sequences are numbered by length (longest first), then by document and place, so those
    of one length are one gapless bucket, no sequence holds two documents and none is padded.
    Numbers come from counts per task and length (a listing as long as there are tasks).
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    spark = docs.sparkSession
    common.ready(spark)
    bits = length.bit_length() - 1
    kinds = [length >> i for i in range(bits + 1)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = _encoded(batch, tokenizer, end_id)
            data = memoryview(ids.tobytes())
            crc = [np.array([zlib.crc32(data[4 * (a + s) : 4 * (a + s + n)]) for s, n in pieces_of(z - a, length)], dtype="<u4").tobytes() for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(crc, pa.binary())], names=["doc_id", "doc_tokens", "crcs"])

    encoded = common.stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, doc_tokens long, crcs binary"), "packed")
    # Ranges keep equal keys together; the crcs split a key that many rows repeat.
    placed = encoded.repartitionByRange("doc_id", "doc_tokens", "crcs").sortWithinPartitions("doc_id", "doc_tokens", "crcs")
    placed = common.stored(placed.withColumn("part", F.spark_partition_id()), "packed-ranges")
    common.discard(encoded)
    count = {k: (F.floor(F.col("doc_tokens") / length) if k == length else F.shiftright("doc_tokens", k.bit_length() - 1).bitwiseAND(1)).cast("long") for k in kinds}
    totals = placed.groupBy("part").agg(*[F.sum(count[k]).alias(f"n{k}") for k in kinds]).orderBy("part").collect()
    before: dict[int, dict[int, int]] = {r["part"]: {} for r in totals}
    at = 0
    for k in kinds:
        for r in totals:
            before[r["part"]][k] = at
            at += r[f"n{k}"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = None, None
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            docs_, seqs = [], []
            for doc, n, crcs, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "part"))):
                if p != part:
                    part, done = p, dict(before[p])
                for (s, m), c in zip(pieces_of(n, length), np.frombuffer(crcs, "<u4").tolist()):
                    docs_.append(doc)
                    for col, v in zip(cols, (s, m, c, n, done[m])):
                        col.append(v)
                    done[m] += 1
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.array(np.zeros(len(docs_), np.int64))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    # A write task of the ranges is one file; each file is read by one task, in order.
    by_part = placed.repartition("part").sortWithinPartitions("part", "doc_id", "doc_tokens", "crcs")
    return by_part.mapInArrow(number, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), tokenizer_path())


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(common.table(spark, sf_dir, "documents"), tokenizer_path()))
