"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables.

A line's key is the line stripped of blanks and U+0009-U+000D at both ends, A-Z in lower
case; keys of at least ``MIN_CHARS`` code points count. The exact tables are

* ``postings`` (key, doc_id): which document holds which key, once each;
* ``counts`` (shard, key, n_docs, last_doc): references per key, and the largest
  document that holds it;
* ``filters`` (shard, slots): a cuckoo filter per shard of the keys with ``min_docs`` or
  more references.

A key is the 128-bit hash of its line as two longs, so a table row has a bounded size.
``LineIndex.insert`` adds documents and ``delete`` takes documents out again: counts go
up and down by the documents' own keys, and a shard's filter inserts keys that reach
``min_docs`` and deletes keys that fall below it, touching no other key. Deleting what
was inserted restores every table. A change reads the tables but writes only what it
changes, as a layer over them; every ``LAYERS`` changes the layers are merged, and if the
repeated keys have outgrown their shards, the filters are dealt to more shards.

Dropping lines: a line that its shard's filter doesn't know stays, without a look-up.
Lines that pass are joined with the exact counts, which removes the filter's false
positives. Filters hold about two bytes a repeated key; up to ``FILTER_BYTES`` all of them
go to all tasks, beyond that every filter goes to the lines of its shard, which are
parted into blocks of about ``BLOCK_ROWS`` lines, so that no shard is too large for a task.

A key with ``min_docs`` references loses all its lines except in the largest document
that holds it.

Edge cases: a null or empty text is one empty line; a null id counts as one document
below all others; repeated rows hold the same keys once and are each returned; an empty
table gives an empty result; extra columns are ignored. Inserting a document that is
held raises an error, since its lines would count twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BLANKS, map_batches, settle, text_bytes

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys that a shard's filter is laid out for; shards follow the number of repeated keys.
SHARD_KEYS = 1 << 16
#: Filters are broadcast up to this many bytes.
FILTER_BYTES = 64 << 20
#: Lines of a shard that one task checks at a time where filters aren't broadcast.
BLOCK_ROWS = 1 << 20
#: Changes after which the layers of an index are merged.
LAYERS = 8
#: Stands for a null id.
NO_ID = -(1 << 63)
_BLANKS = BLANKS.encode()


def line_key(line: bytes) -> bytes | None:
    """The key, or None if it is too short to count."""
    line = line.strip(_BLANKS)
    if len(line) < MIN_CHARS or (not line.isascii() and len(line.decode()) < MIN_CHARS):
        return None
    return line.translate(ASCII_LOWER)


def hashed_key(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    value = xxhash.xxh3_128_intdigest(key)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; two buckets a key, each found from the other.

    Holds a multiset: inserting twice and deleting once leaves one."""

    SLOTS = 4

    def __init__(self, slots: np.ndarray):
        self.slots = slots  # uint16, a row for each bucket; 0 is free
        self.mask = len(slots) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (0.8 * cls.SLOTS)))))
        return cls(np.zeros((buckets, cls.SLOTS), np.uint16))

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, bucket, other bucket) of 64-bit hashes."""
        hashes = hashes.view(np.uint64)
        marks = (hashes >> np.uint64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        first = (hashes & np.uint64(self.mask)).astype(np.int64)
        return marks, first, first ^ self.hop(marks)

    def hop(self, marks: np.ndarray) -> np.ndarray:
        return (marks.astype(np.int64) * 0x5BD1E995) & self.mask

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        marks, a, b = self.places(hashes)
        return ((self.slots[a] == marks[:, None]) | (self.slots[b] == marks[:, None])).any(axis=1)

    def _put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = mark
        return bool(len(free))

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there is no room: the caller builds a larger filter from the exact table."""
        marks, a, b = self.places(hashes)
        for mark, first, second in zip(marks.tolist(), a.tolist(), b.tolist()):
            if self._put(first, mark) or self._put(second, mark):
                continue
            bucket = second
            for kick in range(500):
                slot = (mark + kick) % self.SLOTS
                out = int(self.slots[bucket, slot])
                self.slots[bucket, slot] = mark
                mark = out
                bucket ^= int(self.hop(np.array([mark], np.uint16))[0])
                if self._put(bucket, mark):
                    break
            else:
                return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        marks, a, b = self.places(hashes)
        for mark, *buckets in zip(marks.tolist(), a.tolist(), b.tolist()):
            for bucket in buckets:
                held = np.flatnonzero(self.slots[bucket] == mark)
                if len(held):
                    self.slots[bucket, held[0]] = 0
                    break

    @classmethod
    def of(cls, hashes: np.ndarray, room: int = 0) -> CuckooFilter:
        """A filter of these keys, grown until all fit."""
        room = max(room, len(hashes))
        while True:
            made = cls.sized(room)
            if made.insert(hashes):
                return made
            room = 2 * max(room, 8)


def postings_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, doc_id): the keys of each row, once each."""

    def run(batch: pa.RecordBatch) -> dict:
        high, low, ids = [], [], []
        for doc, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            own = {hashed_key(k) for line in set(raw.split(b"\n")) if (k := line_key(line)) is not None}
            for a, b in own:
                high.append(a)
                low.append(b)
            ids += [doc] * len(own)
        return {"k1": high, "k2": low, "doc_id": ids}

    return map_batches(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), text), "k1 bigint, k2 bigint, doc_id bigint", run)


def count_keys(postings: DataFrame) -> DataFrame:
    """(k1, k2, n_docs, last_doc). Postings are summed before they are shuffled, so a key that
    a third of all documents hold reaches its task as one row from each other task."""
    return postings.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def with_shard(counts: DataFrame, shards: int) -> DataFrame:
    return counts.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int"))


def build_filters(repeated: DataFrame) -> DataFrame:
    """(shard, slots) from (shard, k2) of the keys to hold."""

    def build(group: pa.Table) -> pa.Table:
        made = CuckooFilter.of(np.sort(group["k2"].to_numpy()), SHARD_KEYS // 8)
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "slots": pa.array([made.slots.tobytes()], pa.binary())})

    return repeated.select("shard", "k2").groupBy("shard").applyInArrow(build, "shard int, slots binary")


def update_filters(filters: DataFrame, changes: DataFrame, counts: DataFrame, min_docs: int) -> DataFrame:
    """Filters of the shards in ``changes`` (shard, k2, step), after keys were inserted (1) or
    deleted (-1). A filter without room is built anew from the exact counts of its shard."""

    def change(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        shard = key[0].as_py() if hasattr(key[0], "as_py") else key[0]
        steps, hashes = new["step"].to_numpy(), new["k2"].to_numpy()
        slots = old["slots"][0].as_py() if old.num_rows else None
        made = CuckooFilter(np.frombuffer(slots, np.uint16).reshape(-1, CuckooFilter.SLOTS).copy()) if slots else CuckooFilter.sized(SHARD_KEYS // 8)
        made.delete(np.sort(hashes[steps < 0]))
        fits = made.insert(np.sort(hashes[steps > 0]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "slots": pa.array([made.slots.tobytes() if fits else None], pa.binary())})

    touched = filters.join(changes.select("shard").distinct(), "shard", "left_semi")
    changed = settle(touched.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, "shard int, slots binary"), "filters")
    full = changed.filter("slots IS NULL").select("shard")
    if full.isEmpty():
        return changed
    anew = build_filters(counts.filter(F.col("n_docs") >= min_docs).join(full, "shard", "left_semi"))
    return settle(changed.filter("slots IS NOT NULL").union(anew), "filters")


def overlaid(below: DataFrame, above: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``above``, and those of ``below`` whose ``by`` it lacks."""
    return below.join(above.select(*by), by, "left_anti").select(*below.columns).union(above.select(*below.columns))


class LineIndex:
    """The state of an incremental line dedup: postings, counts and filters as tables."""

    def __init__(self, postings: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int, layers: int = 0):
        self.postings, self.filters, self.shards, self.min_docs, self.layers = postings, filters, shards, min_docs, layers
        self.counts = with_shard(counts.select("k1", "k2", "n_docs", "last_doc"), shards)

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> LineIndex:
        """The index of ``docs``; the same as an empty one into which they are inserted."""
        # repeated ids would count twice: a row for each key and document
        postings = postings_of(docs, key, text)
        ids = docs.groupBy(F.col(key).alias("_id")).agg(F.count(F.lit(1)).alias("_rows"))
        if not ids.filter("_rows > 1").isEmpty():
            postings = postings.distinct()
        postings = settle(postings, "postings")
        counts = settle(count_keys(postings), "counts")
        shards, filters = cls.dealt(counts, min_docs)
        return cls(postings, counts, filters, shards, min_docs)

    @staticmethod
    def dealt(counts: DataFrame, min_docs: int) -> tuple[int, DataFrame]:
        """(number of shards, their filters) of all repeated keys."""
        repeated = counts.filter(F.col("n_docs") >= min_docs)
        shards = 1 + repeated.count() // SHARD_KEYS
        return shards, settle(build_filters(with_shard(repeated, shards)), "filters")

    def _changed(self, postings: DataFrame, moved: DataFrame) -> LineIndex:
        """The index after the keys of ``moved`` (k1, k2, before, n_docs, last_doc) took new counts."""
        counts = overlaid(self.counts.drop("shard"), moved, ["k1", "k2"]).filter("n_docs > 0")
        now, was = F.col("n_docs") >= self.min_docs, F.col("before") >= self.min_docs
        changes = settle(with_shard(moved.filter(now != was), self.shards).select("shard", "k2", F.when(now, 1).otherwise(-1).alias("step")), "changes")
        filters = self.filters
        if not changes.isEmpty():
            filters = overlaid(filters, update_filters(filters, changes, with_shard(counts, self.shards), self.min_docs), ["shard"])
        made = LineIndex(postings, counts, filters, self.shards, self.min_docs, self.layers + 1)
        return made.merged() if made.layers >= LAYERS else made

    def merged(self) -> LineIndex:
        """The same index with its layers written as one table each."""
        postings, counts = settle(self.postings, "postings"), settle(self.counts.drop("shard"), "counts")
        repeated = counts.filter(F.col("n_docs") >= self.min_docs).count()
        if repeated // SHARD_KEYS > 2 * self.shards:
            shards, filters = self.dealt(counts, self.min_docs)
        else:
            shards, filters = self.shards, settle(self.filters, "filters")
        return LineIndex(postings, counts, filters, shards, self.min_docs)

    def insert(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> LineIndex:
        """The index with ``docs``, whose ids must be new to it."""
        own = settle(postings_of(docs, key, text).distinct(), "postings")
        if not self.postings.join(own.select("doc_id").distinct(), "doc_id", "left_semi").isEmpty():
            raise ValueError("documents to insert are already in the index: delete them first")
        new = count_keys(own).withColumnRenamed("last_doc", "new_last").withColumnRenamed("n_docs", "step")
        old = self.counts.select("k1", "k2", F.col("n_docs").alias("held"), "last_doc")
        before = F.coalesce("held", F.lit(0))
        moved = new.join(old, ["k1", "k2"], "left").select(
            "k1", "k2", before.alias("before"), (before + F.col("step")).alias("n_docs"), F.greatest("last_doc", "new_last").alias("last_doc")
        )
        return self._changed(self.postings.union(own), settle(moved, "moved"))

    def delete(self, ids: DataFrame) -> LineIndex:
        """The index without the documents in the single column of ``ids``."""
        gone = settle(ids.select(F.coalesce(F.col(ids.columns[0]).cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct(), "gone")
        rest = self.postings.join(gone, "doc_id", "left_anti").select("k1", "k2", "doc_id")
        lost = count_keys(self.postings.join(gone, "doc_id", "left_semi")).select("k1", "k2", F.col("n_docs").alias("step"), F.col("last_doc").alias("gone_last"))
        touched = settle(self.counts.join(lost, ["k1", "k2"]), "touched")
        # where the largest document went, the remaining postings of the key tell the next
        open_ = touched.filter((F.col("gone_last") == F.col("last_doc")) & (F.col("n_docs") > F.col("step")))
        latest = rest.join(open_.select("k1", "k2"), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.max("doc_id").alias("next_last"))
        moved = touched.join(latest, ["k1", "k2"], "left").select(
            "k1", "k2", F.col("n_docs").alias("before"), (F.col("n_docs") - F.col("step")).alias("n_docs"), F.coalesce("next_last", "last_doc").alias("last_doc")
        )
        return self._changed(rest, settle(moved, "moved"))

    def maybe_repeated(self) -> DataFrame:
        """Postings that their shard's filter knows: all that repeat, and a few more."""
        size = self.filters.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
        if size > FILTER_BYTES:
            return self.maybe_repeated_by_shard()
        held = {r[0]: CuckooFilter(np.frombuffer(r[1], np.uint16).reshape(-1, CuckooFilter.SLOTS)) for r in self.filters.collect()}
        shared = self.postings.sparkSession.sparkContext.broadcast(held)
        shards = self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                home = np.mod(batch.column("k1").to_numpy(), shards)
                hashes = batch.column("k2").to_numpy()
                known = np.zeros(len(home), bool)
                for shard in np.unique(home).tolist():
                    if shard in shared.value:
                        own = np.flatnonzero(home == shard)
                        known[own] = shared.value[shard].contains(hashes[own])
                yield batch.filter(pa.array(known))

        return self.postings.mapInArrow(run, self.postings.schema)

    def maybe_repeated_by_shard(self) -> DataFrame:
        """The same, with every filter met by the postings of its shard, a block at a time."""
        placed = with_shard(self.postings, self.shards)
        blocks = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))  # a row a shard
        blocks = settle(blocks, "blocks")
        left = placed.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int")).drop("blocks")
        right = self.filters.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "slots")

        def check(postings: pa.Table, filters: pa.Table) -> pa.Table:
            postings = postings.select(["k1", "k2", "doc_id"])
            if not filters.num_rows:
                return postings.slice(0, 0)
            known = CuckooFilter(np.frombuffer(filters["slots"][0].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS))
            return postings.filter(pa.array(known.contains(postings["k2"].to_numpy())))

        return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(check, self.postings.schema)

    def drops(self) -> DataFrame:
        """(doc_id, keys): of each document that loses lines, the keys it loses."""
        repeated = self.counts.filter(F.col("n_docs") >= self.min_docs).select("k1", "k2", "last_doc")
        lost = self.maybe_repeated().join(repeated, ["k1", "k2"]).filter("doc_id <> last_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))

    def save(self, path: str) -> None:
        for name in ("postings", "counts", "filters"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.shards, self.min_docs)], "shards int, min_docs int").write.mode("overwrite").parquet(f"{path}/parameters")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        told = spark.read.parquet(f"{path}/parameters").first()
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "counts", "filters")), told.shards, told.min_docs)


def drop_lines(docs: DataFrame, index: LineIndex, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) of every row: its lines without those it loses."""
    lost = index.drops().withColumnRenamed("doc_id", "_lost")
    joined = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    joined = joined.join(lost, F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_lost"), "left")

    def run(batch: pa.RecordBatch) -> dict:
        kept, n_lines, n_dropped = [], [], []
        for raw, keys in zip(text_bytes(batch.column("text")), batch.column("keys").to_pylist()):
            lines = raw.split(b"\n")
            n_lines.append(len(lines))
            if keys:
                gone = {(k["k1"], k["k2"]) for k in keys}
                stay = [x for x in lines if (k := line_key(x)) is None or hashed_key(k) not in gone]
                n_dropped.append(len(lines) - len(stay))
                raw = b"\n".join(stay)
            else:
                n_dropped.append(0)
            kept.append(raw)
        return {"doc_id": batch.column("doc_id"), "text": pa.array(kept, pa.binary()).cast(pa.string()), "n_lines": n_lines, "n_dropped": n_dropped}

    return map_batches(joined.select("doc_id", "text", "keys"), "doc_id bigint, text string, n_lines bigint, n_dropped bigint", run)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """Contract of op1."""
    docs = docs.select("doc_id", "text")
    kept = drop_lines(docs, LineIndex.build(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


DEDUP_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

