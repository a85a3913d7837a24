"""Benchmark decontamination by spaced seeds.

Texts become words (A-Z lower-cased, runs of letters, digits and non-ASCII
characters). A mask marks which of a window's positions count; its hash ignores
the others, so a changed word there does no harm. Hashes of the benchmark and of
the documents are joined under each mask; a hit names a benchmark item and the
diagonal (document position less item position) on which both run. Around every
hit, words are compared along the diagonal, substitutions allowed.

A document holds an item if somewhere on a diagonal at least ``MIN_WORDS`` words in a
row (the whole item if it is shorter) agree in a share of ``SIMILARITY`` or more. Items
of 13 words and more have weight-5 masks, after the rule of five words for word shingles;
``MASKS`` hit every window of 13 words with up to two substitutions. Items of 5 to 12
words have lighter masks (``SHORT_MASKS``), which hit the item with any one (5 to 9 words)
or two words changed; a test enumerates all patterns of all lengths. Items of one to four
words have one mask, the whole item, and match where they are quoted exactly. Such quotes
happen by chance, so ``decontaminate`` doesn't drop a document for them unless its
``fewest`` says so; ``overlaps`` reports them with their ``item_words``.

The benchmark's hashes and words reach the tasks by broadcast, ``CHUNK_WORDS`` words
at a time: a larger benchmark is cut into chunks of items and the documents are read
once for each chunk, so the broadcast never grows with the data.

Edge cases: null and empty texts and items match nothing; repeated rows are reported for
each; a null id is reported as null (and its row goes with the others); of an item's
equally good places the first is reported; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

MASKS = ("11111", "1101011", "10000010111")
#: Masks of items of 5 to 12 words.
SHORT_MASKS = ("111", "11011")
MIN_WORDS = 13
#: Items with fewer words must be quoted exactly, and alone don't drop a document.
FEWEST = 5
SIMILARITY = 0.8
#: Words of benchmark text in one broadcast (about 60 bytes each with their hashes).
CHUNK_WORDS = 1_000_000
#: Bits of the table that rejects most hashes before the exact look-up.
SCREEN_BITS = 22
#: Pairs of equal hashes, and pairs of short items and places, worked on at a time.
PAIRS = 1 << 18
SCHEMA = "doc_id bigint, item_id bigint, start_word int, n_words int, n_same int, similarity double, item_words int"

_WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def seed_hashes(hashed: np.ndarray, mask: str) -> np.ndarray:
    """Of each position, the hash of the window that starts there, counting marked positions only."""
    n = len(hashed) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        out *= factor
        out += hashed[at : at + n]
    return out


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of ``n`` words."""
    return MASKS if n >= MIN_WORDS else SHORT_MASKS if n >= FEWEST else ("1" * n,)


class Chunk:
    """A bounded part of the benchmark: words of its items, and sorted seed hashes under each mask.

    ``masks`` are those of the items' lengths; each has the sorted hashes, their places in the
    items' words, and a table that rejects most hashes."""

    def __init__(self, items: list[tuple[int, bytes]], fewest: int = 1):
        parts = [(i, word_hashes(words_of(t))) for i, t in items]
        parts = [(i, w) for i, w in parts if len(w) >= fewest]
        self.ids = [i for i, _ in parts]
        self.words = np.concatenate([w for _, w in parts]) if parts else np.zeros(0, np.uint64)
        self.starts = np.concatenate(([0], np.cumsum([len(w) for _, w in parts]))).astype(np.int64)
        self.lengths = np.diff(self.starts)
        own: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for start, (_, words) in zip(self.starts.tolist(), parts):
            for mask in masks_of(len(words)):
                hashes = seed_hashes(words, mask)
                own.setdefault(mask, []).append((hashes, start + np.arange(len(hashes))))
        self.seeds = []
        for mask, found in own.items():
            values, places = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(values, kind="stable")
            values = values[order]
            screen = np.zeros(1 << SCREEN_BITS, bool)
            screen[(values >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)] = True
            self.seeds.append((mask, values, places[order].astype(np.int64), screen))

    def hits(self, hashed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document position, benchmark position) of equal seed hashes, some at a time."""
        for mask, values, places, screen in self.seeds:
            own = seed_hashes(hashed, mask)
            maybe = np.flatnonzero(screen[(own >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            low = np.searchsorted(values, own[maybe], "left")
            count = np.searchsorted(values, own[maybe], "right") - low
            maybe, low, count = maybe[count > 0], low[count > 0], count[count > 0]
            upto = np.cumsum(count)
            at = 0
            while at < len(maybe):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                n = count[at:end]
                first = np.repeat(low[at:end] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
                yield np.repeat(maybe[at:end], n), places[first + np.arange(n.sum())]
                at = end

    def diagonals(self, hashed: np.ndarray) -> np.ndarray:
        """Rows (item index, diagonal) of all hits, once each, by item and diagonal."""
        found = []
        for at, to in self.hits(hashed):
            item = np.searchsorted(self.starts, to, "right") - 1
            found.append(np.unique(np.stack([item, at - (to - self.starts[item])], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def overlaps(self, hashed: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(item index, start, words, same words, item words) of the best overlap with each held item."""
        pairs = self.diagonals(hashed)
        if not len(pairs):
            return []
        short = self.lengths[pairs[:, 0]] < MIN_WORDS
        best = self.short_overlaps(hashed, pairs[short]) if short.any() else {}
        for k, diagonal in pairs[~short].tolist():
            s, e = int(self.starts[k]), int(self.starts[k + 1])
            if k in best and best[k][2] == e - s:  # the whole item, which nothing betters
                continue
            low, high = max(0, diagonal), min(len(hashed), diagonal + e - s)
            same = hashed[low:high] == self.words[s + low - diagonal : s + high - diagonal]
            found = best_run(same, MIN_WORDS)
            if found and (k not in best or found[2] > best[k][2]):
                best[k] = (low + found[0], found[1], found[2])
        return [(k, *v, int(self.lengths[k])) for k, v in sorted(best.items())]

    def short_overlaps(self, hashed: np.ndarray, pairs: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Of short items and diagonals, (start, words, same words) of each held item's best
        place. The whole item lies in the document; many places are compared at once."""
        best: dict[int, tuple[int, int, int]] = {}
        lengths = self.lengths[pairs[:, 0]]
        for n in np.unique(lengths).tolist():
            least = n if n < FEWEST else -(-4 * n // 5)
            own = pairs[(lengths == n) & (pairs[:, 1] >= 0) & (pairs[:, 1] + n <= len(hashed))]
            for at in range(0, len(own), PAIRS):
                item, place = own[at : at + PAIRS].T
                same = hashed[place[:, None] + np.arange(n)] == self.words[self.starts[item][:, None] + np.arange(n)]
                total = same.sum(axis=1)
                for i in np.flatnonzero(total >= least).tolist():
                    k = int(item[i])
                    if k not in best or total[i] > best[k][2]:
                        inside = np.flatnonzero(same[i])
                        best[k] = int(place[i] + inside[0]), int(inside[-1] - inside[0] + 1), int(total[i])
        return best


def best_run(same: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """(start, words, same words) of the longest stretch of ``least`` or more words that
    agree in a share of SIMILARITY, cut to its first and last agreeing words; or None."""
    n = len(same)
    if n < least or same.sum() < SIMILARITY * least:
        return None
    # prefix sums of (1 - SIMILARITY) for a same word and -SIMILARITY for another, in fifths
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
    low = np.minimum.accumulate(score)
    stops = np.arange(least, n + 1)
    begins = np.searchsorted(-low, -score[least:], "left")  # the first place from which the share holds
    longest = int(np.argmax(stops - begins))
    best = int(begins[longest]), int(stops[longest])
    if best[1] - best[0] < least:
        return None
    inside = np.flatnonzero(same[best[0] : best[1]])
    start, stop = best[0] + int(inside[0]), best[0] + int(inside[-1]) + 1
    return start, stop - start, len(inside)


def chunks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, bytes]]]:
    """Items in bounded chunks: rows arrive partition by partition and only a chunk is held."""
    held, words = [], 0
    for row in benchmark.select(item, text).filter(F.col(text).isNotNull()).toLocalIterator():
        own = row[1].encode()
        held.append((row[0], own))
        words += len(words_of(own))
        if words >= CHUNK_WORDS:
            yield held
            held, words = [], 0
    if held:
        yield held


def overlaps(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", fewest: int = 1
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_same, similarity, item_words): a row for each
    document and item of ``fewest`` words or more that it holds, with the best overlap."""
    docs = docs.select(F.col(key).cast("long"), text)
    found = None
    for part in chunks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Chunk(part, fewest))

        def run(batch: pa.RecordBatch, shared=shared) -> dict:
            chunk = shared.value
            out: dict[str, list] = {n: [] for n in ("doc_id", "item_id", "start_word", "n_words", "n_same", "similarity", "item_words")}
            for doc, raw in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                for k, start, n, same, whole in chunk.overlaps(word_hashes(words_of(raw))):
                    for name, value in zip(out, (doc, chunk.ids[k], start, n, same, same / n, whole)):
                        out[name].append(value)
            return out

        own = map_batches(docs, SCHEMA, run)
        found = own if found is None else found.union(own)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", fewest: int = FEWEST) -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark with ``fewest`` words or
    more. Each row is judged by its own text: rows without an id go too, and rows that share
    one don't decide for each other."""
    at, schema = docs.columns.index(text), docs.schema
    for part in chunks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(Chunk(part, fewest))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not shared.value.overlaps(word_hashes(words_of(raw))) for raw in text_bytes(batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
