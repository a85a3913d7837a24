"""LM scoring by context-tree weighting.

Bytes (A-Z lower-cased; newlines before the text, byte 0 after it) are predicted bit by
bit. Every context of 0 to ``DEPTH`` preceding bytes holds a binary tree over the bits of
the next byte, with a Krichevsky-Trofimov estimate in each node. The weighted
probability of a node mixes its own estimate with the product of the next depth's, half
and half, so all depths up to ``DEPTH`` take part, weighted by how well they coded the
training documents. A text's score is log10 of the probability that the trained tree
gives it; ``code_length`` is bits per byte.

Counts come from all training documents: tasks add up the keys (context, byte) that they
see, and Spark adds up the tasks. The tree is computed by tasks from the summed keys, a
piece each: a piece is a range of the two bytes nearest to the predicted one with at most
``PIECE_KEYS`` keys. Only the tops of the trees (depths 0 and 1, of a fixed size) are
shared by pieces; they are added up first. A piece's task gives the log probability of
each of its keys, so that scoring a text is looking up its keys.

Those tables reach the tasks by broadcast, ``TABLE_KEYS`` keys of 16 bytes at a time, and a
text is read once for each. (To join the keys of texts with the tables instead would
shuffle ten times the texts.) Every part is a job of its own and its table is dropped
after it, so neither the plan nor what is held grows with the keys. Keys that no training
document has, a few of a held-out text, are collected as distinct keys and go to
the pieces, whose tasks walk down the tree for them.

The base score, a smoothed unigram model of words, has a vocabulary without bound. The
``TOP_WORDS`` most frequent words, the only ones that can crowd a join, are broadcast;
all others are joined by word with the full table of counts.

Edge cases: a null or empty text is the end mark alone; rows without an id are held
out; repeated rows train as often as they occur and are each returned; without training
documents every bit has probability one half and base counts are 0; an empty table gives
an empty result; extra columns are ignored; a text of any length is worked on in segments.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, crc32_of_id, map_batches, settle, text_bytes

DEPTH = 4
FOLDS = 10
START, END = b"\n", b"\0"
#: Bytes of text that a task works on at a time.
SEGMENT = 2 << 20
#: Keys of a piece: about 100 bytes each in a task, nodes included.
PIECE_KEYS = 2_000_000
#: Keys whose log probabilities are broadcast at a time.
TABLE_KEYS = 4_000_000
#: Keys or words that a task holds before it hands on its counts.
HELD = 1_000_000
TOP_WORDS = 1 << 16
SMOOTHING = 0.1


def held_out(key: Column) -> Column:
    return crc32_of_id(key) % FOLDS == 0


def keyed_segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, starts, keys): keys of all predicted bytes, in segments of bounded size.

    A key has the DEPTH bytes before the predicted one, the nearest first, then that byte."""
    held: list[tuple[int, bytes]] = []
    size = 0

    def keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(p for _, p in held), np.uint8).astype(np.uint64)
        lengths = np.array([len(p) for _, p in held])
        first = np.cumsum(lengths) - lengths
        made = data.copy()
        for back in range(1, DEPTH + 1):
            made[back:] |= data[:-back] << np.uint64(8 * (DEPTH + 1 - back))
        real = np.ones(len(data), bool)
        real[(first[:, None] + np.arange(DEPTH)).ravel()] = False
        return np.array([d for d, _ in held]), first - DEPTH * np.arange(len(held)), made[real]

    for doc, text in enumerate(texts):
        whole = START * DEPTH + text.translate(ASCII_LOWER) + END
        for at in range(DEPTH, len(whole), SEGMENT):
            part = whole[at - DEPTH : at + SEGMENT]
            held.append((doc, part))
            size += len(part)
            if size >= SEGMENT:
                yield keys()
                held, size = [], 0
    if held:
        yield keys()


def key_counts(docs: DataFrame) -> DataFrame:
    """(key, n) over all texts of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(held), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(held[at : at + (1 << 17)].view(np.int64)), pa.array(n[at : at + (1 << 17)])], names=["key", "n"])

        for batch in batches:
            for _, _, keys in keyed_segments(text_bytes(batch.column(0))):
                coded = pa.array(keys).dictionary_encode()
                new = coded.dictionary.to_numpy()
                times = np.bincount(coded.indices.to_numpy(), minlength=len(new))
                both, place = np.unique(np.concatenate((held, new)), return_inverse=True)
                n = np.bincount(place, np.concatenate((n, times)), len(both)).astype(np.int64)
                held = both
                if len(held) >= HELD:
                    yield from out()
                    held, n = held[:0], n[:0]
        yield from out()

    return docs.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts of ``docs``, end marks not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, times = list(seen), list(seen.values())
            for at in range(0, len(words), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + (1 << 16)], pa.binary()).cast(pa.string()), pa.array(times[at : at + (1 << 16)], pa.int64())], names=["word", "n"])

        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                seen.update(raw.translate(ASCII_LOWER).split())
                if len(seen) >= HELD // 4:
                    yield from out()
                    seen.clear()
        yield from out()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series after a shift by 8."""
    low = np.ones_like(x)
    for i in range(8):
        low = low * (x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


class Nodes:
    """Nodes of one depth and bit: sorted keys (context, node), counts of both bits, and for each
    (context, byte) row of the deepest contexts the node it passes. Counts are kept where the
    top needs them, at depth 2; elsewhere what is derived from them is enough."""

    def __init__(self, contexts: np.ndarray, symbols: np.ndarray, n: np.ndarray, bit: int, depth: int):
        node = (np.uint64(1 << bit)) | (symbols >> np.uint64(8 - bit))
        one = (symbols >> np.uint64(7 - bit)) & np.uint64(1)
        keys = contexts << np.uint64(8) | node
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        self.keys = keys[new]
        of_row = (np.cumsum(new) - 1).astype(np.int32)
        ones = np.bincount(of_row, n * one, len(self.keys)).astype(np.float64)
        zeros = np.bincount(of_row, n, len(self.keys)) - ones
        if depth == DEPTH:
            self.of_row, self.one_of_row = of_row, one.astype(bool)
        if depth == 2:
            self.zeros, self.ones = zeros, ones
        self.one = kt_one(zeros, ones)
        self.estimate = log_kt(zeros, ones)
        self.weighted = self.estimate

    def parents(self) -> np.ndarray:
        """Keys of the same nodes one byte of context shorter."""
        return self.keys >> np.uint64(16) << np.uint64(8) | self.keys & np.uint64(255)

    def mix(self, deeper: Nodes) -> None:
        deeper.up = np.searchsorted(self.keys, deeper.parents()).astype(np.int32)
        below = np.bincount(deeper.up, deeper.weighted, len(self.keys))
        self.weighted = np.logaddexp(self.estimate, below) - np.log(2)

    def descend(self, mixed: np.ndarray, left: np.ndarray, last: bool) -> None:
        """From what the shorter contexts give (probability of a one so far, weight left)."""
        stop = np.ones(len(self.keys)) if last else np.exp(self.estimate - np.log(2) - self.weighted)
        self.mixed = mixed + left * stop * self.one
        self.left = left * (1 - stop)
        del self.one, self.estimate, self.weighted


class Top:
    """Depths 0 and 1, dense: [context byte, node]; depth 0 has one context."""

    def __init__(self):
        self.zeros, self.ones, self.below = (np.zeros((256, 256)) for _ in range(3))

    def add(self, level: list[Nodes]) -> None:
        """Depth-2 nodes of a piece."""
        for nodes in level:
            at = (nodes.keys >> np.uint64(16)).astype(np.int64), (nodes.keys & np.uint64(255)).astype(np.int64)
            flat = at[0] * 256 + at[1]
            for held, new in ((self.zeros, nodes.zeros), (self.ones, nodes.ones), (self.below, nodes.weighted)):
                held += np.bincount(flat, new, 65536).reshape(256, 256)

    def finish(self) -> None:
        estimate = log_kt(self.zeros, self.ones)
        weighted = np.logaddexp(estimate, self.below) - np.log(2)
        zeros, ones = self.zeros.sum(axis=0), self.ones.sum(axis=0)
        root = log_kt(zeros, ones)
        stop = np.exp(root - np.log(2) - (np.logaddexp(root, weighted.sum(axis=0)) - np.log(2)))
        mixed, left = stop * kt_one(zeros, ones), 1 - stop
        stop = np.exp(estimate - np.log(2) - weighted)
        self.mixed, self.left = mixed + left * stop * kt_one(self.zeros, self.ones), left * (1 - stop)
        #: Probability of a one where the context of two bytes was never seen with this node.
        self.one = self.mixed + self.left / 2


def levels_of(keys: np.ndarray, n: np.ndarray) -> list[list[Nodes]]:
    """Of sorted keys, the nodes of depths DEPTH to 2, deepest first, eight bits each, weighted."""
    found: list[list[Nodes]] = []
    contexts, symbols = keys >> np.uint64(8), keys & np.uint64(255)
    for depth in range(DEPTH, 1, -1):
        if depth < DEPTH:  # a shorter context: add up rows with the same rest
            merged, place = np.unique(contexts >> np.uint64(8) << np.uint64(8) | symbols, return_inverse=True)
            n = np.bincount(place, n, len(merged))
            contexts, symbols = merged >> np.uint64(8), merged & np.uint64(255)
        level = [Nodes(contexts, symbols, n, bit, depth) for bit in range(8)]
        if found:
            for nodes, deeper in zip(level, found[-1]):
                nodes.mix(deeper)
        found.append(level)
    return found


class Piece:
    """What scores the positions whose nearest two bytes are in [low, high)."""

    def __init__(self, low: int, high: int, keys: np.ndarray, n: np.ndarray, top: Top):
        self.low, self.high, self.keys, self.top = low, high, keys, top.one
        levels = levels_of(keys, n)
        for depth, level in enumerate(reversed(levels), 2):
            for bit, nodes in enumerate(level):
                if depth == 2:
                    at = (nodes.keys >> np.uint64(16)).astype(np.int64), (nodes.keys & np.uint64(255)).astype(np.int64)
                    mixed, left = top.mixed[at], top.left[at]
                else:
                    upper = levels[DEPTH - depth + 1][bit]
                    mixed, left = upper.mixed[nodes.up], upper.left[nodes.up]
                nodes.descend(mixed, left, depth == DEPTH)
        self.log = np.zeros(len(keys))
        for nodes in levels[0] if levels else []:
            one = nodes.mixed[nodes.of_row]
            self.log += np.log10(np.where(nodes.one_of_row, one, 1 - one))
        #: By depth from the deepest and bit: node keys, probability of a one if nothing deeper was seen.
        self.nodes = [[(x.keys, x.mixed + x.left / 2) for x in level] for level in levels]

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's byte in its context."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = np.zeros(len(keys))
        out[known] = self.log[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.unseen(keys[new])
        return out

    def unseen(self, keys: np.ndarray) -> np.ndarray:
        contexts, symbols = keys >> np.uint64(8), keys & np.uint64(255)
        nearest = (contexts >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
        total = np.zeros(len(keys))
        for bit in range(8):
            node = (np.uint64(1 << bit)) | (symbols >> np.uint64(8 - bit))
            one = self.top[nearest, node.astype(np.int64)]
            for depth in range(2, DEPTH + 1):  # deeper contexts overrule
                held, probability = self.nodes[DEPTH - depth][bit]
                sought = contexts >> np.uint64(8 * (DEPTH - depth)) << np.uint64(8) | node
                if len(held):
                    place = np.minimum(np.searchsorted(held, sought), len(held) - 1)
                    one = np.where(held[place] == sought, probability[place], one)
            bits = ((symbols >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(bits, one, 1 - one))
        return total


def look_up(texts: list[bytes], held: np.ndarray, logs: np.ndarray, low: int, high: int) -> tuple[np.ndarray, list[dict[int, int]]]:
    """Of each text, the sum of the log probabilities of its keys in [low, high), and how
    often it has keys of that range that the table (``held`` in order) lacks."""
    total = np.zeros(len(texts))
    lacking: list[dict[int, int]] = [{} for _ in texts]
    for docs, starts, keys in keyed_segments(texts):
        coded = pa.array(keys).dictionary_encode()
        distinct, places = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        own = (distinct >= np.uint64(low)) & (distinct < np.uint64(high))
        at = np.minimum(np.searchsorted(held, distinct), max(0, len(held) - 1))
        known = own & (held[at] == distinct) if len(held) else np.zeros(len(distinct), bool)
        np.add.at(total, docs, np.add.reduceat(np.where(known, logs[at] if len(held) else 0.0, 0.0)[places], starts))
        new = np.flatnonzero((own & ~known)[places])
        if len(new):
            of = docs[np.searchsorted(starts, new, "right") - 1]
            for doc, key in zip(of.tolist(), keys[new].tolist()):
                lacking[doc][key] = lacking[doc].get(key, 0) + 1
    return total, lacking


def pieces_of(counts: DataFrame) -> list[tuple[int, int, int]]:
    """(low, high, keys): ranges of the nearest two bytes, covering all, each with at most
    PIECE_KEYS keys (or one pair of bytes, whose keys are bounded by 256 ** (DEPTH - 1))."""
    near = F.shiftrightunsigned("key", 8 * (DEPTH - 1)).alias("near")
    sizes = dict(counts.groupBy(near).count().collect())  # 65,536 rows at most
    cuts, held = [0], [0]
    for at in sorted(sizes):
        if held[-1] and held[-1] + sizes[at] > PIECE_KEYS:
            cuts.append(at)
            held.append(0)
        held[-1] += sizes[at]
    return list(zip(cuts, [*cuts[1:], 1 << 16], held))


def tables_of(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Ranges of keys, covering all, of neighbouring pieces with at most TABLE_KEYS keys in all."""
    cuts, held = [0], 0
    for low, _, n in ranges:
        if held and held + n > TABLE_KEYS:
            cuts.append(low)
            held = 0
        held += n
    shift = 8 * (DEPTH - 1)
    return [(a << shift, b << shift) for a, b in zip(cuts, [*cuts[1:], 1 << 16])]


def with_piece(keys: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """``keys`` with the number of the piece that they lie in."""
    cuts = F.array(*[F.lit(low) for low, _, _ in ranges])
    near = F.shiftrightunsigned("key", 8 * (DEPTH - 1))
    return keys.withColumn("piece", F.size(F.filter(cuts, lambda c: c <= near)) - 1)


def sorted_keys(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, n = group["key"].to_numpy().view(np.uint64), group["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.float64)


class Tree:
    """The trained tree, as what tasks need to compute its pieces."""

    def __init__(self, counts: DataFrame):
        self.ranges = pieces_of(counts)
        self.counts = with_piece(counts, self.ranges)

        def upper(group: pa.Table) -> pa.Table:
            own = Top()
            own.add(levels_of(*sorted_keys(group))[-1])
            at = np.flatnonzero(own.zeros + own.ones)
            return pa.table({"cell": at, **{n: getattr(own, n).ravel()[at] for n in ("zeros", "ones", "below")}})

        sums = self.counts.groupBy("piece").applyInArrow(upper, "cell bigint, zeros double, ones double, below double")
        sums = sums.groupBy("cell").agg(*[F.sum(n).alias(n) for n in ("zeros", "ones", "below")]).toArrow()  # 65,536 rows at most
        self.top = Top()
        for name in ("zeros", "ones", "below"):
            getattr(self.top, name).ravel()[sums["cell"].to_numpy()] = sums[name].to_numpy()
        self.top.finish()

    def _piece(self) -> Callable[[pa.Table, int], Piece]:
        shared = self.counts.sparkSession.sparkContext.broadcast((self.top, self.ranges))

        def piece(group: pa.Table, at: int) -> Piece:
            top, ranges = shared.value
            return Piece(*ranges[at][:2], *sorted_keys(group), top)

        return piece

    def logs(self) -> DataFrame:
        """(key, log): log10 of the probability of each trained key's byte in its context."""
        piece = self._piece()

        def run(group: pa.Table) -> pa.Table:
            made = piece(group, group["piece"][0].as_py())
            return pa.table({"key": made.keys.view(np.int64), "log": made.log})

        return self.counts.groupBy("piece").applyInArrow(run, "key bigint, log double")

    def logs_of_unseen(self, keys: DataFrame) -> DataFrame:
        """(key, log) of distinct keys that no training document has."""
        piece = self._piece()

        def run(at: tuple, trained: pa.Table, sought: pa.Table) -> pa.Table:
            own = sought["key"].to_numpy()
            if not len(own):
                return pa.table({"key": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
            number = at[0].as_py() if hasattr(at[0], "as_py") else at[0]
            made = piece(trained.select(["key", "n"]), number)
            logs = np.concatenate([made.unseen(own[i : i + SEGMENT].view(np.uint64)) for i in range(0, len(own), SEGMENT)])
            return pa.table({"key": own, "log": logs})

        sought = with_piece(keys, self.ranges)
        return self.counts.groupBy("piece").cogroup(sought.groupBy("piece")).applyInArrow(run, "key bigint, log double")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Contract of op10: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    code_length) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    training = rows.filter(~held_out(F.col("doc_id")))
    counts = settle(key_counts(training), "context-counts")
    words = settle(word_counts(training), "word-counts")
    n_training = training.count()
    sums = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    tokens = (sums[0] or 0) + n_training
    distinct = sums[1] + (n_training > 0)
    floor = float(np.log10(tokens + SMOOTHING * (distinct + 1)))
    top = {r.word.encode(): float(np.log10(r.n + SMOOTHING)) for r in words.orderBy(F.col("n").desc(), "word").limit(TOP_WORDS).collect()}
    end = float(np.log10(n_training + SMOOTHING))
    tree = Tree(counts)
    logs = settle(tree.logs(), "logs")
    tables = tables_of(tree.ranges)
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    if len(tables) > 1:  # several readings must see the same numbers
        numbered = settle(numbered, "numbered")

    def table(low: int, high: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        got = logs.filter((F.col("key") >= low) & (F.col("key") < high)).toArrow()
        keys, values = got["key"].to_numpy().view(np.uint64), got["log"].to_numpy()
        order = np.argsort(keys)
        return keys[order], values[order], low, high

    def sums(texts: list[bytes], held: tuple[np.ndarray, np.ndarray, int, int]) -> dict:
        total, lacking = look_up(texts, *held)
        cuts = pa.array(np.cumsum([0, *map(len, lacking)]), pa.int32())
        unseen = pa.array([k for x in lacking for k in x], pa.int64())
        often = pa.array([n for x in lacking for n in x.values()], pa.int64())
        return {"part": total, "unseen": pa.ListArray.from_arrays(cuts, unseen), "often": pa.ListArray.from_arrays(cuts, often)}

    shared = spark.sparkContext.broadcast((table(*tables[0]), top))

    def run(batch: pa.RecordBatch) -> dict:
        held, frequent = shared.value
        texts = text_bytes(batch.column("text"))
        n_words, known, base = [], [], []
        rare: list[bytes] = []
        times: list[int] = []
        cuts = [0]
        for raw in texts:
            own = Counter(raw.translate(ASCII_LOWER).split())
            total, n_top = end, int(n_training > 0)
            for word, n in own.items():
                value = frequent.get(word)
                if value is None:
                    rare.append(word)
                    times.append(n)
                else:
                    total += n * value
                    n_top += n
            n_words.append(own.total() + 1)
            known.append(n_top)
            base.append(total)
            cuts.append(len(rare))
        return {
            "row": batch.column("row"),
            "doc_id": batch.column("doc_id"),
            "n_tokens": n_words,
            "n_top": known,
            "base_top": base,
            "rare": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rare, pa.binary()).cast(pa.string())),
            "times": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(times, pa.int64())),
            "n_bytes": [len(t) for t in texts],
            **sums(texts, held),
        }

    own = "row bigint, part double, unseen array<bigint>, often array<bigint>"
    schema = f"{own}, doc_id bigint, n_tokens bigint, n_top bigint, base_top double, rare array<string>, times array<bigint>, n_bytes bigint"
    read = settle(map_batches(numbered, schema, run), "scored")
    shared.destroy()
    sparse = read.select("row", F.inline(F.arrays_zip("rare", "times")))
    sparse = sparse.join(words, F.col("rare") == F.col("word"), "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING)).alias("base_rare"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare"),
    )
    parts = read.select("row", "part")
    lacking = read.select("row", F.inline(F.arrays_zip("unseen", "often")))
    for part in tables[1:]:
        more = spark.sparkContext.broadcast(table(*part))
        found = settle(map_batches(numbered, own, lambda batch, more=more: {"row": batch.column("row"), **sums(text_bytes(batch.column("text")), more.value)}), "scored")
        more.destroy()
        parts = parts.union(found.select("row", "part"))
        lacking = lacking.union(found.select("row", F.inline(F.arrays_zip("unseen", "often"))))
    unseen = settle(tree.logs_of_unseen(lacking.select(F.col("unseen").alias("key")).distinct()), "unseen")
    walked = lacking.join(unseen, F.col("unseen") == F.col("key")).groupBy("row").agg(F.sum(F.col("often") * F.col("log")).alias("walked"))
    whole = read.select("row", "doc_id", "n_tokens", "n_top", "base_top", "n_bytes", "part").join(sparse, "row", "left").join(walked, "row", "left")
    if len(tables) > 1:
        whole = whole.drop("part").join(parts.groupBy("row").agg(F.sum("part").alias("part")), "row")
    whole = whole.withColumn("part", F.col("part") + F.coalesce("walked", F.lit(0.0)))
    return whole.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        F.col("part").alias("score"),
        (-F.col("part") * float(np.log2(10)) / (F.col("n_bytes") + 1)).alias("code_length"),
    )
