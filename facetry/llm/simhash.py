"""SimHash near-duplicates: fingerprints, linked exactly within 3 differing bits.

Candidates come from a segment-popcount embedding. The 64 bits are cut into 32
segments of two bits; a fingerprint's image is the vector of its segments' bit
counts (0, 1 or 2). The Manhattan distance of two images is a lower bound of the
Hamming distance, so fingerprints that link lie within Manhattan distance 3.

The range join runs on a grid of cell width 1. A range join in 32 dimensions would
probe a ball of cells; instead the dimensions are dealt into ``groups`` slabs, and
two images within distance 3 differ in at most 3 slabs, so they share a cell in at
least one of the C(groups, 3) grids that leave out 3 slabs. More slabs mean finer
cells (and more grids): ``grid_groups`` takes them from the number of distinct
fingerprints, so a cell's expected load stays bounded at every size. Pairs in a
cell are kept if their images are within distance 3 and their fingerprints within
3 bits; a cell then reports links that span its linked pieces, never all pairs.

Equal fingerprints are one node, so groups of copies cost nothing. A crowded cell
is cut into blocks of ``BLOCK`` rows and every pair of blocks is a task of its own,
so no task holds an unbounded cell.

Edge cases: null and empty texts have no shingle, fingerprint zero, and link like
any other; fewer than three words make one shingle; repeated rows are one node
through their fingerprint and are all returned; a null id is returned and counts
only where its whole component has no id (component_id is then null); an empty
table gives an empty result; extra columns are ignored.

Near-dedup of a corpus (``drop_near_duplicates``) links texts whose sets of word
shingles have a Jaccard similarity of ``SIMILAR`` or more. It takes the same steps with
wider bounds, since the fingerprints of such texts differ in about 0.15 of their bits:
sketches of 256 bits, the same image of two-bit segments, cells on sub-grids, the Manhattan
bound, the Hamming distance, spanning links and components. No set of sub-grids is
exact for so many bits, so each takes a few drawn segments, as many as keep a cell's
load near ``LOAD``, and their number is such that a pair at the threshold shares no cell
with a probability of ``MISS`` at most (``grids_of``; sets of 4 and 5 shingles, whose
majorities differ most, a little more). An exact check follows: within a
component the sets of shingles are compared, and only similar texts stay linked.

What is linked isn't linked again: the first ``FIRST_GRIDS`` sub-grids join most of a group, and
the others report only links between pieces that are still apart. A crowded cell (or component)
is first linked within blocks of its rows; then blocks meet each other, but for those of the
largest piece, so a group of near copies costs rows and links in proportion to its size, not to
its square. Pieces that stay apart meet in pairs of blocks, since all their pairs have to be compared.
Bits that tie (even numbers of shingles) are those of the smallest hash, so that sketches
of few shingles are spread like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BLANKS, map_batches, settle, shuffle_partitions, text_bytes

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SEGMENTS = 32
#: Rows of a cell that one task compares with as many others.
BLOCK = 2048
#: Pairs compared at a time in a task.
PAIRS = 1 << 20
#: Near-dedup of a corpus: words of a shingle, and the Jaccard similarity that links.
CORPUS_SHINGLE = 5
SIMILAR = 0.8
#: Words of 64 bits in a sketch, the fingerprint for near-dedup of a corpus.
SKETCH_WORDS = 4
#: The share of pairs at the threshold that may share no cell, and that may exceed the bits.
MISS = 1e-5
BEYOND = 1e-6
#: How much more than ``flips`` sets of few shingles differ (0.8: at worst 3/16, 4 beside 5).
FEW = 1.25
#: Sketches that one meets in a cell, about, and segments of a cell at least.
LOAD = 16384
LEAST_SEGMENTS = 4
#: Sub-grids whose links are joined to pieces before the others look for more.
FIRST_GRIDS = 4
#: Sketches of a cell that one task compares with as many others, and pairs at a time.
SKETCH_BLOCK = 32768
SKETCH_PAIRS = 1 << 15
#: Texts of a component that one task compares, with their shingles, with as many others.
SET_BLOCK = 1024
#: Texts to compare that are looked up by broadcast; more are met in a shuffle.
BROADCAST_NODES = 4_000_000


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words; of all the words where they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    hashed = xxhash.xxh64_intdigest
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter((hashed(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, len(starts))


def fingerprint(words: list[bytes]) -> int:
    """Majority of the bits of the shingles' XXH64; 0 without words."""
    if not words:
        return 0
    values = shingle_hashes(words, SHINGLE)
    if len(values) == 1:
        return int(values[0])
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):  # 64 bytes a shingle are unpacked at a time
        piece = values[at : at + (1 << 15)]
        bits = np.unpackbits(piece.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.flatnonzero(2 * counts > len(values))
    return int(sum(1 << int(b) for b in ones))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        found = np.fromiter((fingerprint(t.translate(ASCII_LOWER).split()) for t in text_bytes(batch.column(1))), np.uint64, batch.num_rows)
        return {key: batch.column(0), "fp": pa.array(found.view(np.int64))}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), text), f"{key} bigint, fp bigint", run)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def image(fps: np.ndarray) -> np.ndarray:
    """Segment bit counts, two bits each, packed into 64 bits: low bit + high bit of each pair."""
    low, odd = np.uint64(0x5555555555555555), np.uint64(1)
    return (fps & low) + ((fps >> odd) & low)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over segments of |a - b| of two packed images."""
    # 0, 1, 2 in unary are 00, 01, 11; unary codes differ in |a - b| bits
    low, odd = np.uint64(0x5555555555555555), np.uint64(1)
    unary = [x | ((x >> odd) & low) for x in (a, b)]
    return popcount(unary[0] ^ unary[1])


def grid_groups(distinct: int) -> int:
    """Slabs for so many fingerprints: cells of the sub-grids, at about 1.5 bits a
    segment, should outnumber the fingerprints; 6 at least, 11 at most."""
    for groups in range(6, 11):
        if 1.5 * SEGMENTS * (groups - 3) / groups >= log2(max(distinct, 2)) + 2:
            return groups
    return 11


def grid_masks(groups: int) -> list[int]:
    """Of each sub-grid, the bits of its segments. Segments are dealt in turn."""
    slabs = [sum(3 << (2 * s) for s in range(g, SEGMENTS, groups)) for g in range(groups)]
    return [((1 << 64) - 1) ^ sum(slabs[g] for g in out) for out in combinations(range(groups), 3)]


def cells(nodes: DataFrame, groups: int) -> DataFrame:
    """(fp) -> (cell, fp): a row for each sub-grid."""
    masks = np.array(grid_masks(groups), np.uint64)
    salt = (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def run(batch: pa.RecordBatch) -> dict:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        with np.errstate(over="ignore"):
            seen = (image(fps)[:, None] & masks) + np.arange(len(masks), dtype=np.uint64)[None, :] * salt
            mixed = (seen ^ (seen >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(29)
        return {"cell": pa.array(mixed.ravel().view(np.int64)), "fp": pa.array(np.repeat(fps, len(masks)).view(np.int64))}

    return map_batches(nodes.select("fp"), "cell bigint, fp bigint", run, 8192)


def spanning(left: np.ndarray, right: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Of these pairs, those that join two pieces that ``parent`` doesn't yet join."""

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    links = []
    for a, b in zip(left.tolist(), right.tolist()):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            links.append((a, b))
    return links


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs, those within the Manhattan bound and then within the bits."""
    near = np.flatnonzero(manhattan(image(a), image(b)) <= MAX_BITS)
    return near[popcount(a[near] ^ b[near]) <= MAX_BITS]


def pairs_of_groups(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices i < j of all pairs in groups of up to 64 rows, by group size, some at a time."""
    for size in np.unique(sizes):
        own = starts[sizes == size]
        i, j = np.triu_indices(int(size), 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            yield (base + i).ravel(), (base + j).ravel()


def link_groups(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that span what pairs within a group connect; in a group of two blocks (side 0 and
    1), pairs across. Groups share what they have connected: no link is told twice."""
    links: list[tuple[int, int]] = []
    parent: dict[int, int] = {}
    sizes = ends - starts
    small = (sizes >= 2) & (sizes <= 64)
    if small.any():
        for i, j in pairs_of_groups(starts[small], sizes[small]):
            kept = verified(fps[i], fps[j])
            links += spanning(fps[i[kept]], fps[j[kept]], parent)
    for s, e in zip(starts[sizes > 64].tolist(), ends[sizes > 64].tolist()):
        own, across = fps[s:e], side[s:e]
        second = across.any()
        step = max(1, PAIRS // len(own))
        for at in range(0, len(own), step):
            i = np.arange(at, min(at + step, len(own)))
            i = i[across[i] == 0]
            a = np.repeat(i, len(own))
            b = np.tile(np.arange(len(own)), len(i))
            keep = across[b] == 1 if second else b > a
            a, b = a[keep], b[keep]
            kept = verified(own[a], own[b])
            links += spanning(own[a[kept]], own[b[kept]], parent)
    return links


def links(nodes: DataFrame, distinct: int) -> DataFrame:
    """(fp) distinct -> (src, dst): links that connect what 3 bits or fewer connect."""
    spark = nodes.sparkSession
    placed = cells(nodes, grid_groups(distinct))
    crowded = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = placed.join(crowded, "cell")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    shared = shared.select("cell", "fp", blocks.alias("blocks"), block.alias("block"))
    meets = meetings(F.col("blocks"), F.col("block"))
    dealt = shared.select("cell", "fp", F.explode(F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side")))).otherwise(meets)).alias("at"))
    task = F.xxhash64("cell", "at.a", "at.b").alias("task")
    dealt = dealt.select(task, F.col("at.side").alias("side"), "fp")
    dealt = dealt.repartition(shuffle_partitions(spark), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: list[pa.RecordBatch], last: bool) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
            whole = pa.Table.from_batches(rows).combine_chunks()
            tasks = whole["task"].to_numpy()
            fps = whole["fp"].to_numpy().view(np.uint64)
            side = whole["side"].to_numpy()
            cuts = np.flatnonzero(tasks[1:] != tasks[:-1]) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(tasks)]))
            rest: list[pa.RecordBatch] = []
            if not last:  # the last group may go on in the next batch
                rest = whole.slice(int(starts[-1])).to_batches()
                starts, ends = starts[:-1], ends[:-1]
            found = np.array(link_groups(fps, starts, ends, side), np.uint64).reshape(-1, 2)
            found = np.unique(np.sort(found, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64))], names=["src", "dst"]), rest

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                out, held = done(held, False)
                yield out
        if held:
            yield done(held, True)[0]

    return dealt.mapInArrow(run, "src bigint, dst bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(src, dst) -> (node, root), root the smallest node reachable; alternating
    large-star and small-star rounds, each written to the shared folder."""
    both = lambda e: e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = settle(edges.filter("src <> dst"), "links")
    before = None
    while True:
        near = both(edges)
        low = near.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        large = near.join(low, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src <> dst").distinct()
        # small star: the smaller neighbours and the node itself are tied to the smallest
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        least = down.groupBy("src").agg(F.min("dst").alias("low"))
        joined = down.join(least, "src")
        tied = joined.filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        own = least.select("src", F.col("low").alias("dst"))
        edges = settle(tied.union(own).distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    return edges.groupBy("src").agg(F.min("dst").alias("root")).select(F.col("src").alias("node"), "root")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every row of ``docs``."""
    marked = settle(fingerprints(docs, key, text), "fingerprints")
    nodes = settle(marked.groupBy("fp").agg(F.min(key).alias("low")), "nodes")
    found = components(links(nodes, nodes.count()))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(best, "root").select("fp", "component_id")
    return marked.join(named, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finish."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Majority of the bits of distinct hashes in order, each mixed into 256 bits; ties take the first's."""
    salts = np.arange(SKETCH_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * SKETCH_WORDS, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        wide = mixed(hashes[at : at + 255, None] + salts).astype("<u8")
        bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)  # eight counts at a time
        first = bits[0] if at == 0 else first
    ones = 2 * counts + first > len(hashes)
    return np.packbits(ones, bitorder="little").view("<u8").astype(np.uint64)


def flips(similarity: float) -> float:
    """The share of bits that differ between sketches of equally large sets of this Jaccard similarity."""
    return acos(2 * similarity / (1 + similarity)) / pi


def share_of_bits(q: float, bits: int) -> np.ndarray:
    """The probability of 0, 1, ... differing bits, if each differs with probability q."""
    return np.array([comb(bits, d) * q**d * (1 - q) ** (bits - d) for d in range(bits + 1)])


def most_bits(similarity: float, bits: int) -> int:
    """Bits that sets of this similarity, of few shingles too, exceed with a probability of BEYOND at most."""
    more = 1 - np.cumsum(share_of_bits(FEW * flips(similarity), bits))
    return int(np.argmax(more <= BEYOND))


def grids_of(distinct: int, similarity: float) -> tuple[int, int]:
    """Segments of a sub-grid, and sub-grids, for so many sketches."""
    segments, bits = LEAST_SEGMENTS, 64 * SKETCH_WORDS
    while distinct * 0.375**segments > LOAD and segments < 32:  # counts of two random bits agree by 3/8
        segments += 1
    likely, flipped = share_of_bits(flips(similarity), bits), np.arange(bits + 1) / bits
    apart = 1 - ((1 - flipped) ** 2 + flipped**2 / 2) ** segments  # both bits stay, or 01 and 10 change places
    low, high = 1, 1
    while (likely * apart**high).sum() > MISS and high < 1 << 20:
        low, high = high, 2 * high
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if (likely * apart**middle).sum() <= MISS else (middle + 1, high)
    return segments, low


def drawn_masks(segments: int, grids: int) -> np.ndarray:
    """Of each sub-grid, the bits of its segments, by word."""
    rng = np.random.default_rng(SEED)
    masks = np.zeros((grids, SKETCH_WORDS), np.uint64)
    for own in masks:
        for s in rng.choice(SEGMENTS * SKETCH_WORDS, segments, replace=False).tolist():
            own[s // SEGMENTS] |= np.uint64(3 << 2 * (s % SEGMENTS))
    return masks


def packed(sketches: np.ndarray) -> pa.Array:
    """A sketch a row, as bytes."""
    width = 8 * SKETCH_WORDS
    offsets = np.arange(len(sketches) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(sketches), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(sketches, "<u8"))])


def unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, SKETCH_WORDS)


def sketch_cells(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(fp, piece) -> (cell, piece, fp): a row for each sub-grid."""
    salt = mixed(masks.copy()).sum(axis=1, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> dict:
        fps = unpacked(batch.column(0))
        seen, cell = image(fps), np.broadcast_to(salt, (len(fps), len(salt)))
        for word in range(SKETCH_WORDS):
            cell = mixed(cell ^ (seen[:, word, None] & masks[:, word]))
        piece = np.repeat(batch.column(1).to_numpy(), len(masks))
        return {"cell": pa.array(cell.ravel().view(np.int64)), "piece": pa.array(piece), "fp": packed(np.repeat(fps, len(masks), axis=0))}

    return map_batches(nodes.select("fp", "piece"), "cell bigint, piece bigint, fp binary", run, 512)


def within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Of pairs of sketches, those within the Manhattan bound and then within the bits."""
    near = np.flatnonzero(manhattan(image(a), image(b)).sum(axis=1, dtype=np.int64) <= most)
    return near[popcount(a[near] ^ b[near]).sum(axis=1, dtype=np.int64) <= most]


def join_pieces(a: np.ndarray, b: np.ndarray, piece: np.ndarray) -> list[tuple[int, int]]:
    """Of these pairs (in order of a), those that span what ``piece`` doesn't yet join."""
    links = []
    while True:
        open_ = piece[a] != piece[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return links
        own = b[: np.searchsorted(a, a[0], "right")]
        new, at = np.unique(piece[own], return_index=True)
        links += [(int(a[0]), int(x)) for x in own[at]]
        piece[np.isin(piece, new)] = piece[a[0]]


def near_sketches(fps: np.ndarray, side: np.ndarray, piece: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of links that span what sketches within the bits connect and ``piece`` doesn't yet;
    with two sides, across."""
    if (piece == piece[0]).all():
        return []
    half, most = most_bits(similarity, 128), most_bits(similarity, 64 * SKETCH_WORDS)
    order = np.argsort(side, kind="stable")
    fps, second = fps[order], int(np.count_nonzero(side == 0)) if side.any() else 0
    one, two = (np.ascontiguousarray(fps[:, w]) for w in (0, 1))
    piece, links, at = piece[order], [], 0
    while at < (second or len(fps)):
        start = second or at
        end = min(second or len(fps), at + max(1, SKETCH_PAIRS // max(1, len(fps) - start)))
        bits = popcount(one[at:end, None] ^ one[start:])
        bits += popcount(two[at:end, None] ^ two[start:])
        a, b = np.divmod(np.flatnonzero(bits.ravel() <= half), len(fps) - start)
        a, b = a + at, b + start
        open_ = (a < b) & (piece[a] != piece[b])
        a, b = a[open_], b[open_]
        if len(a):
            kept = within(fps[a], fps[b], most)
            links += join_pieces(a[kept], b[kept], piece)
        at = end
    return [(int(order[a]), int(order[b])) for a, b in links]


def meetings(blocks: Column, block: Column) -> Column:
    """A row of block b meets every block: as the left side of (b, c), c >= b, and the right side of (a, b), a < b."""
    return F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda c: F.struct(F.least(block, c).alias("a"), F.greatest(block, c).alias("b"), (c < block).cast("int").alias("side")),
    )


def apart(rows: DataFrame, item: str, size: int) -> DataFrame:
    """(cell, piece, item, ...) with (task, side): every two rows of a cell that are of two pieces meet
    in a task of blocks of about ``size`` rows. Blocks of a cell's largest piece don't meet each other."""
    pieces = rows.groupBy("cell", "piece").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "piece"))
    seen = pieces.groupBy("cell").agg(most.alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    seen = seen.select(F.col("cell").alias("__cell"), F.col("most.piece").alias("__most"), *[F.ceil(n / size).cast("int").alias(f"__{x}") for n, x in ((F.col("most.n"), "own"), (F.col("n") - F.col("most.n"), "rest"))])
    seen = settle(seen, "seen")
    rows = rows.join(F.broadcast(seen) if seen.count() <= BROADCAST_NODES else seen, F.col("cell") == F.col("__cell"))
    own = F.col("piece") == F.col("__most")
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(item, "cell"), F.when(own, F.col("__own")).otherwise(F.col("__rest"))).cast("int"))
    block = F.col("__block")
    place = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), F.lit(side).alias("side"))  # noqa: E731  blocks of the largest piece count down from -1
    of_own = F.transform(F.sequence(F.lit(0), F.col("__rest") - 1), lambda c: place(c, -1 - block, 1))
    of_rest = F.transform(F.sequence(F.lit(0), F.col("__own") - 1), lambda c: place(block, -1 - c, 0))
    rows = rows.withColumn("__at", F.explode(F.when(own, of_own).otherwise(F.concat(of_rest, meetings(F.col("__rest"), block)))))
    rows = rows.withColumns({"task": F.xxhash64("cell", "__at.a", "__at.b"), "side": F.col("__at.side")})
    return rows.drop("__cell", "__most", "__own", "__rest", "__block", "__at")


def blocks_of(rows: DataFrame, item: str, n: Column, size: int, salt: int = 0) -> DataFrame:
    """(cell, item, ...) with (task, side): every row in one block of about ``size`` of its cell's n rows."""
    block = F.pmod(F.xxhash64(F.col(item), F.col("cell"), F.lit(salt)), F.ceil(n / size))
    return rows.withColumns({"task": F.xxhash64(F.col("cell"), block, F.lit(salt)), "side": F.lit(0)})


def near_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """(task, side, piece, fp) -> (src, dst): what the tasks link, by the sketches' hashes."""
    dealt = dealt.select("task", "side", "piece", "fp").repartition(shuffle_partitions(dealt.sparkSession), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # of one task

        def done() -> pa.RecordBatch:
            side, piece, fps = (np.concatenate([x[at] for x in held]) for at in range(3))
            found = np.array(near_sketches(fps, side, piece, similarity), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([packed(fps[found[:, at]]) for at in (0, 1)], names=["src", "dst"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tasks, side, piece, fps = *(batch.column(at).to_numpy() for at in range(3)), unpacked(batch.column(3))
            cuts = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
            for start, end in zip(cuts, cuts[1:]):
                if held and tasks[start] != last:
                    yield done()
                    held.clear()
                last = tasks[start]
                held.append((side[start:end], piece[start:end], fps[start:end]))
        if held:
            yield done()

    found = dealt.mapInArrow(run, "src binary, dst binary").select(F.xxhash64("src").alias("src"), F.xxhash64("dst").alias("dst"))
    return settle(found.distinct(), "near")


def with_pieces(rows: DataFrame, name: Column, links: DataFrame) -> DataFrame:
    """``rows`` with ``piece``: the root of what the links join to the node of this name, or that node."""
    found = components(links).select(F.col("node").alias("__found"), F.col("root").alias("__root"))
    return settle(rows.join(found, name == F.col("__found"), "left").withColumn("piece", F.coalesce("__root", name)).drop("__found", "__root"), "pieces")


def sketch_links(nodes: DataFrame, distinct: int, similarity: float = SIMILAR) -> DataFrame:
    """(fp) distinct -> (src, dst): links that connect sketches within the bits of this similarity."""
    masks = drawn_masks(*grids_of(distinct, similarity))
    nodes, name = nodes.select("fp"), F.xxhash64("fp")
    pieces, links, crowds = nodes.withColumn("piece", name), None, 0
    for own in filter(len, (masks[:FIRST_GRIDS], masks[FIRST_GRIDS:])):
        if links is not None:
            pieces = with_pieces(nodes, name, links)
        placed = sketch_cells(pieces, own)
        crowded = settle(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SKETCH_BLOCK), "crowded")
        n = crowded.count()
        placed = placed.join(F.broadcast(crowded) if n <= BROADCAST_NODES else crowded, "cell", "left")
        found = near_links(blocks_of(placed, "fp", F.coalesce("n", F.lit(1)), SKETCH_BLOCK), similarity)
        many = crowded if links is None else many.union(crowded)
        links, crowds = found if links is None else links.union(found), crowds + n
    if crowds:
        placed = sketch_cells(with_pieces(nodes, name, links), masks)
        placed = placed.join(F.broadcast(many) if crowds <= BROADCAST_NODES else many, "cell", "left_semi")
        links = links.union(near_links(apart(settle(placed, "crowds"), "fp", SKETCH_BLOCK), similarity))
    return links.distinct()


def node_of(text: str) -> Column:
    """A text's identity, which equal texts share: its hash; 0 for a text without words. Texts that
    differ in case or blanks only are nodes of their own, linked by their equal sets of shingles."""
    bare = F.btrim(F.col(f"`{text}`"), F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(f"`{text}`")))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


def nodes_with_sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, node, fp): a row for each of ``docs``; without words fp is null."""

    def run(batch: pa.RecordBatch) -> dict:
        found = []
        for raw in text_bytes(batch.column(2)):
            words = words_of(raw)
            found.append(sketch(np.unique(shingle_hashes(words, shingle))).tobytes() if words else None)
        return {key: batch.column(0), "node": batch.column(1), "fp": found}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), node_of(text).alias("node"), text), f"{key} bigint, node bigint, fp binary", run)


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str, shingle: int) -> DataFrame:
    """(node, held): of each wanted node, its distinct shingle hashes in order, as bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "held": [np.unique(shingle_hashes(words_of(t), shingle)).tobytes() for t in text_bytes(batch.column(1))]}

    few = wanted.count() <= BROADCAST_NODES
    found = docs.select(node_of(text).alias("node"), F.col(text).alias("text"))
    found = found.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")
    return map_batches(found, "node bigint, held binary", run).groupBy("node").agg(F.first("held").alias("held"))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets of ordered hashes reaches the threshold."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")  # merges two ordered runs
    shared = np.count_nonzero(both[1:] == both[:-1])
    return shared >= similarity * (len(both) - shared) - 1e-9


def similar_links(nodes: np.ndarray, side: np.ndarray, piece: np.ndarray, held: list[bytes], fps: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links that join what similar pairs, with sketches within the bits, join and ``piece`` doesn't
    yet; with two sides, of pairs across. What is joined is linked to one node of it."""
    if (piece == piece[0]).all():
        return []
    most = most_bits(similarity, 64 * SKETCH_WORDS)
    sets = [np.frombuffer(h, np.uint64) for h in held]
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(x) for x in sets])[order]
    before, at = np.unique(piece[order], return_index=True)
    piece = piece[order]
    sketches = unpacked(pa.array(fps, pa.binary()))[order]
    sides, across = side[order], side.any()
    for j in range(1, len(order)):
        low = int(np.searchsorted(sizes[:j], similarity * sizes[j] - 1e-9))  # smaller sets can't reach it
        open_ = np.arange(low, j)
        if across:
            open_ = open_[sides[low:j] != sides[j]]
        open_ = open_[piece[open_] != piece[j]][::-1]
        open_ = open_[popcount(sketches[open_] ^ sketches[j]).sum(axis=1, dtype=np.int64) <= most]
        while len(open_):
            i, open_ = int(open_[0]), open_[1:]
            if similar(sets[order[i]], sets[order[j]], similarity):
                piece[piece == piece[i]] = piece[j]
                open_ = open_[piece[open_] != piece[j]]
    one = dict(zip(before.tolist(), nodes[order[at]].tolist()))  # a node of each piece
    return [(one[p], n) for p, n in zip(piece[at].tolist(), one.values()) if one[p] != n]


def similar_pairs(nodes: DataFrame, docs: DataFrame, text: str, shingle: int, similarity: float) -> DataFrame:
    """(node, fp) distinct -> (src, dst): links that connect what similar pairs connect, which
    are looked for in the components of the sketches."""
    fps = settle(nodes.filter("fp IS NOT NULL").groupBy("fp").agg(F.count(F.lit(1)).alias("texts")), "sketches")
    found = components(sketch_links(fps.select("fp"), fps.count(), similarity)).withColumnRenamed("node", "__found")
    cells = fps.select("fp", "texts", F.xxhash64("fp").alias("sketch")).join(found, F.col("sketch") == F.col("__found"), "left")
    cells = cells.select("fp", "texts", F.coalesce("root", "sketch").alias("cell"))
    crowded = settle(cells.groupBy("cell").agg(F.sum("texts").alias("n")).filter("n > 1"), "crowded")
    cells = cells.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_NODES else crowded, "cell").select("cell", "fp", "n")
    shared = settle(nodes.select("node", "fp").join(cells, "fp").select("cell", "node", "fp", "n"), "cells")
    sets = settle(shingle_sets(docs, shared.select("node").distinct(), text, shingle), "sets")
    meet = lambda dealt: set_links(dealt.join(sets, "node"), similarity)
    shared = shared.withColumn("piece", F.col("node"))
    wide = shared.filter(F.col("n") > SET_BLOCK)
    # two ways to cut a wide component into blocks, so that the second joins what the first joins within blocks
    links = meet(blocks_of(shared, "node", F.col("n"), SET_BLOCK).union(blocks_of(wide, "node", F.col("n"), SET_BLOCK, 1)))
    if wide.isEmpty():
        return links
    return links.union(meet(apart(with_pieces(wide.drop("piece"), F.col("node"), links), "node", SET_BLOCK))).distinct()


def set_links(dealt: DataFrame, similarity: float) -> DataFrame:
    """(task, side, piece, node, held, fp) -> (src, dst): what the tasks link."""
    dealt = dealt.select("task", "side", "piece", "node", "held", "fp")
    dealt = dealt.repartition(shuffle_partitions(dealt.sparkSession), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, own = None, []

        def done() -> pa.RecordBatch:
            found = similar_links(*(np.array([x[at] for x in own], np.int64) for at in (2, 0, 1)), [x[3] for x in own], [x[4] for x in own], similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[at] for x in found], pa.int64()) for at in (0, 1)], names=["src", "dst"])

        for batch in batches:
            for now, *row in zip(*(batch.column(n).to_pylist() for n in ("task", "side", "piece", "node", "held", "fp"))):
                if now != task and own:
                    yield done()
                    own = []
                task = now
                own.append(row)
        if own:
            yield done()

    return settle(dealt.mapInArrow(run, "src bigint, dst bigint").distinct(), "similar")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = CORPUS_SHINGLE, similarity: float = SIMILAR) -> DataFrame:
    """One row of each group that similar texts connect: one with the smallest id, or
    without an id where the whole group has none."""
    marked = settle(nodes_with_sketches(docs, key, text, shingle), "marked")
    nodes = settle(marked.groupBy("node").agg(F.min(key).alias("low"), F.first("fp").alias("fp")), "nodes")
    found = components(similar_pairs(nodes, docs, text, shingle, similarity)).withColumnRenamed("node", "__found")
    rooted = nodes.join(found, F.col("node") == F.col("__found"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    best = F.min(F.struct(F.col("low").isNull(), "low", "node")).alias("best")
    heads = rooted.groupBy("root").agg(best).select(F.col("best.low").alias("__head"), F.col("best.node").alias("__text"))
    heads = settle(heads, "heads")
    kept = docs.withColumn("__node", node_of(text)).join(heads, (F.col("__node") == F.col("__text")) & F.col(key).cast("long").eqNullSafe(F.col("__head")), "left_semi")
    rows = marked.join(heads, (F.col("node") == F.col("__text")) & F.col(key).eqNullSafe(F.col("__head")), "left_semi")
    if rows.count() > heads.count():  # rows of one id and text, or of one text without an id
        kept = kept.dropDuplicates(["__node"])
    return kept.drop("__node")
