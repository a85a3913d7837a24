import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from facetry.llm import bitslice, decontam, simhash


def brute_fingerprint(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(low).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 3:
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {f: root(f) for f in parent}


def test_simhash_texts(spark):
    random.seed(5)
    words = ["alpha", "Beta", "gamma", "delta", "éta", "zeta"]
    texts = [" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \t\n", "one", "one two", texts[0], texts[0].upper(), "w " * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id bigint, text string, fp string")
    got = simhash.simhash_components(df).collect()
    assert len(got) == len(texts) + 1
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_components(set(fps))
    low = {}
    for i, f in enumerate(fps):
        low[roots[f]] = min(low.get(roots[f], i), i)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == low[roots[fps[r.doc_id]]]


@pytest.mark.parametrize("crowd", [0, 5000])
def test_simhash_links_and_crowded_cells(spark, crowd, monkeypatch):
    random.seed(7)
    fps = set()
    for _ in range(150):  # chains of near fingerprints
        f = random.getrandbits(64)
        for _ in range(random.randint(1, 4)):
            fps.add(f)
            for b in random.sample(range(64), random.randint(1, 4)):
                f ^= 1 << b
    centre = random.getrandbits(64)
    for _ in range(crowd and 400):  # many within a few bits of one centre
        f = centre
        for b in random.sample(range(64), random.randint(0, 4)):
            f ^= 1 << b
        fps.add(f)
    monkeypatch.setattr(simhash, "BLOCK", 64 if crowd else 2048)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = simhash.links(nodes, len(signed))
    pairs = [(r.src & (1 << 64) - 1, r.dst & (1 << 64) - 1) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    found = {r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in simhash.components(edges).collect()}
    want = brute_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(f)
    for group in groups.values():
        assert len({found.get(f, f) for f in group}) == 1
    assert len({found.get(f, f) for f in fps}) == len(groups)


def test_lower_bound_and_grids():
    random.seed(2)
    a = np.array([random.getrandbits(64) for _ in range(2000)], np.uint64)
    b = np.array([random.getrandbits(64) for _ in range(2000)], np.uint64)
    for x, y, d in zip(a.tolist(), b.tolist(), simhash.manhattan(simhash.image(a), simhash.image(b)).tolist()):
        count = lambda v: [(v >> 2 * s & 1) + (v >> 2 * s + 1 & 1) for s in range(32)]
        assert d == sum(abs(p - q) for p, q in zip(count(x), count(y))) <= (x ^ y).bit_count()
    for groups in (6, 8, 11):
        masks = simhash.grid_masks(groups)
        for x in a[:50].tolist():
            y = x
            for bit in random.sample(range(64), 3):
                y ^= 1 << bit
            ix, iy = (int(simhash.image(np.array([v], np.uint64))[0]) for v in (x, y))
            assert any(ix & m == iy & m for m in masks)


def test_near_dedup_keeps_one_of_each_group(spark):
    texts = ["a b c d e f g h", "A b C d e f g h", "completely other words in here", None, ""]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(2, texts[2], "s"), (None, "x", "s")], "doc_id bigint, text string, source string")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 2, 3]


def shingles_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_dedup_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    random.seed(21)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [" ".join(random.choices(vocabulary, k=random.randint(3, 200))) for _ in range(30)]
    for n in [*range(4, 60, 3), *[150] * 12]:  # copies with a few words changed, on both sides of the threshold
        base = random.choices(vocabulary, k=n)
        for changes in (0, 1, 1, 2, 3):
            words = list(base)
            for at in random.sample(range(n), min(changes, n)):
                words[at] = "other"
            texts.append(" ".join(words))
    base = random.choices(vocabulary, k=100)
    for _ in range(60):  # a large group
        words = list(base)
        words[random.randrange(100)] = random.choice(vocabulary)
        texts.append(" ".join(words))
    held = [shingles_of(t) for t in texts]
    root = list(range(len(texts)))
    far = 0
    for i, j in combinations(range(len(texts)), 2):
        shared = len(held[i] & held[j])
        if 5 * shared >= 4 * (len(held[i]) + len(held[j]) - shared):
            far += (brute_fingerprint(texts[i]) ^ brute_fingerprint(texts[j])).bit_count() > 3
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    assert far > 100  # beyond the bits of op6
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == sorted(set(root))


def test_near_dedup_of_rows_without_id(spark):
    rows = [(None, "one two three four five six"), (None, "One two three four five six"), (None, "alone"), (4, "with an id"), (None, "with an id"), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in simhash.drop_near_duplicates(df).collect()]
    assert sorted((i or 0, len((t or "").split())) for i, t in kept) == [(0, 0), (0, 1), (0, 6), (4, 3)]


def test_near_dedup_of_ids_that_repeat(spark):
    rows = [(1, "first text of the id"), (1, "quite another text than that"), (0, "kept before the others"), (2, "kept before the others"), (2, "only here are these words"), (3, "same again"), (3, "same again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in simhash.drop_near_duplicates(df).collect()) == sorted({*rows} - {rows[3]})


def brute_sketch(hashes):
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    words = []
    for w in range(4):
        own = [mixed((h + w * 0x9E3779B97F4A7C15) & mask) for h in hashes]
        words.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) + (own[0] >> b & 1) > len(own)))
    return words


@pytest.mark.parametrize("n", [1, 2, 5, 254, 255, 256, 700])
def test_sketches(n):
    random.seed(n)
    hashes = sorted(random.getrandbits(64) for _ in range(n))
    assert simhash.sketch(np.array(hashes, np.uint64)).tolist() == brute_sketch(hashes)


def test_sketches_of_few_shingles_are_within_the_bits():
    rng = np.random.default_rng(4)
    most = simhash.most_bits(0.8, 256)
    for hashes in rng.integers(0, 1 << 63, (10_000, 5), np.uint64):  # 4 beside 5: similarity 0.8
        assert simhash.popcount(simhash.sketch(np.sort(hashes[:4])) ^ simhash.sketch(np.sort(hashes))).sum() <= most


@pytest.mark.parametrize("block", [32768, 50])
def test_sketch_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SKETCH_BLOCK", block)
    random.seed(23)
    wide = []
    for size in [1] * 100 + [4] * 40 + [200]:  # alone, small groups, a large one
        centre = random.getrandbits(256)
        for _ in range(size):
            f = centre
            for b in random.sample(range(256), random.randint(0, 35)):
                f ^= 1 << b
            wide.append(f)
    most = simhash.most_bits(simhash.SIMILAR, 256)
    want = {f: i for i, f in enumerate(wide)}
    for a, b in combinations(wide, 2):
        if (a ^ b).bit_count() <= 45 and want[a] != want[b]:
            low, high = sorted((want[a], want[b]))
            want = {f: low if r == high else r for f, r in want.items()}
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(32, "little")),) for f in set(wide)], "fp binary")
    named = {r.id: int.from_bytes(r.fp, "little") for r in nodes.selectExpr("fp", "xxhash64(fp) AS id").collect()}
    edges = simhash.sketch_links(nodes, len(named))
    assert all((named[r.src] ^ named[r.dst]).bit_count() <= most for r in edges.collect())
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    roots = {}
    for i, f in named.items():
        roots.setdefault(want[f], set()).add(found.get(i, i))
    assert all(len(x) == 1 for x in roots.values()) and len(set.union(*roots.values())) >= 120


def test_links_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SKETCH_BLOCK", 50)
    random.seed(31)
    centre = random.getrandbits(256)
    wide = set()
    for _ in range(600):  # near copies of one sketch, many more than a block
        f = centre
        for b in random.sample(range(256), random.randint(0, 20)):
            f ^= 1 << b
        wide.add(f)
    nodes = spark.createDataFrame([(bytearray(f.to_bytes(32, "little")),) for f in wide], "fp binary")
    edges = simhash.sketch_links(nodes, len(wide))
    assert edges.count() <= (simhash.FIRST_GRIDS + 1) * len(wide)
    found = simhash.components(edges).collect()
    assert len(found) == len(wide) - 1 and len({r.root for r in found}) == 1


def test_similar_links_of_a_large_group_grow_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_BLOCK", 8)
    random.seed(33)
    base = random.choices([f"w{i}" for i in range(900)], k=200)
    texts = []
    for i in range(300):  # near copies: 290 of one text, and 10 of half of it
        words = list(base) if i < 290 else base[:100]
        words[random.randrange(len(words))] = f"own{i}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    nodes = simhash.nodes_with_sketches(df, "doc_id", "text", 5).select("node", "fp")
    assert simhash.similar_pairs(nodes, df, "text", 5, 0.8).count() <= 3 * len(texts)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect()) == [0, 290]


def test_apart_brings_together_all_rows_of_different_pieces(spark):
    random.seed(35)
    rows = [(c, random.choice([7, 7, 7, 8, 9, 100 + i]) if c else 7, 1000 * c + i) for c in range(3) for i in range(40 * c + 30)]
    dealt = simhash.apart(spark.createDataFrame(rows, "cell bigint, piece bigint, node bigint"), "node", 8).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault(r.task, []).append(r)
    met = set()
    for own in tasks.values():
        across = any(r.side for r in own) and not all(r.side for r in own)
        met |= {frozenset((a.node, b.node)) for a, b in combinations(own, 2) if not across or a.side != b.side}
        assert len(own) <= 40
    assert {frozenset((a[2], b[2])) for a, b in combinations(rows, 2) if a[0] == b[0] and a[1] != b[1]} <= met
    assert not any(r.cell == 0 for r in dealt)  # of one piece
    main = {r[2] for r in rows if r[1] == 7}
    assert not any(pair <= main for pair in met)


def test_near_dedup_stage_goes_by_fingerprints(spark, monkeypatch):
    random.seed(3)
    words = [f"w{random.randrange(500)}" for _ in range(120)]
    rows = [(0, " ".join(words)), (1, " ".join([*words, "more"])), (2, "quite other words than in those texts")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == [0, 2]
    monkeypatch.setattr(simhash, "sketch_links", lambda nodes, *_: nodes.selectExpr("0L AS src", "0L AS dst").limit(0))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect()) == [0, 1, 2]


# decontamination


def test_masks_hit_all_windows_with_two_substitutions():
    n = decontam.MIN_WORDS
    for wrong in combinations(range(n), 2):
        assert any(all(o + i not in wrong for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for o in range(n - len(m) + 1))


@pytest.mark.parametrize("n", range(1, 21))
def test_every_accepted_pattern_of_every_length(n):
    """All ways to change words that the rule accepts, for items of 1 to 20 words (of 13 and
    more: all of a window of 13 words), are found in a text with other words around."""
    item = [b"i%d" % i for i in range(n)]
    chunk = decontam.Chunk([(7, b" ".join(item))])
    least = min(n, decontam.MIN_WORDS)
    for first in range(n - least + 1):
        for changes in range(least + 1):
            if (5 * (least - changes) < 4 * least) or (n < decontam.FEWEST and changes):
                continue
            for wrong in combinations(range(first, first + least), changes):
                words = [w if first <= i < first + least and i not in wrong else b"other" for i, w in enumerate(item)]
                found = chunk.overlaps(decontam.word_hashes([b"a", b"b", *words, b"c"]))
                assert [(chunk.ids[k], same, whole) for k, _, _, same, whole in found] == [(7, least - changes, n)], (first, wrong)


def brute_held(doc, item):
    """Some stretch on a diagonal of enough words that agrees in 0.8 or more; items of one to
    four words are quoted exactly."""
    d, w = decontam.words_of(doc.encode()), decontam.words_of(item.encode())
    least = min(decontam.MIN_WORDS, len(w))
    if len(w) < decontam.FEWEST:
        return bool(w) and any(d[i : i + len(w)] == w for i in range(len(d)))
    for diagonal in range(-len(w) + 1, len(d)):
        same = [d[i] == w[i - diagonal] for i in range(max(0, diagonal), min(len(d), diagonal + len(w)))]
        for i in range(len(same)):
            for j in range(i + least, len(same) + 1):
                if 5 * sum(same[i:j]) >= 4 * (j - i):
                    return True
    return False


def test_overlaps_against_brute_force(spark, monkeypatch):
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(random.choices(vocabulary, k=n)) for n in (4, 6, 13, 20, 40, 1, 2, 3, 5, 7, 8, 9, 10, 11, 12)] + [None, ""]
    docs = [None, "", "w1 w2"]
    for item in items[:-2]:
        for changes in (0, 1, 2, 3, 6):
            words = item.split()
            for i in random.sample(range(len(words)), min(changes, len(words))):
                words[i] = "changed"
            docs.append(" ".join(random.choices(vocabulary, k=30) + words + random.choices(vocabulary, k=30)).title())
    docs.append(" ".join(random.choices(vocabulary, k=20_000)) + ", " + items[3].upper())
    assert any(brute_held(t, items[0]) for t in docs[3:8])
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    want = {(i, k) for i, t in enumerate(docs[:-1]) for k, item in enumerate(items) if t and item and brute_held(t, item)} | {(len(docs) - 1, 3)}
    found = decontam.overlaps(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(found) == len(got) and {p for p in got if p[0] < len(docs) - 1} | {(len(docs) - 1, 3)} == want and (len(docs) - 1, 3) in got
    long_enough = {(r.doc_id, r.item_id) for r in found if r.item_words >= decontam.FEWEST}
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench, fewest=decontam.FEWEST).collect()} == long_enough
    monkeypatch.setattr(decontam, "CHUNK_WORDS", 10)  # several chunks give the same
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()} == got
    clean = decontam.decontaminate(df, bench)
    assert {i for i, k in got if k == 5} - {i for i, _ in long_enough}  # the one-word item alone drops nothing
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {i for i, _ in long_enough}


def test_decontamination_by_row(spark):
    item = "what is the name of the longest river that runs through the old town"
    docs = spark.createDataFrame([(None, f"so {item} then"), (1, f"{item} again"), (1, "clean"), (None, "clean, too"), (2, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(0, item), (1, None)], "item_id bigint, text string")
    assert decontam.overlaps(docs, bench).count() == 2
    assert sorted(str(r.text) for r in decontam.decontaminate(docs, bench).collect()) == ["None", "clean", "clean, too"]


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.overlaps(docs, none).collect() == [] and decontam.decontaminate(docs, none).count() == 1
    assert decontam.overlaps(docs.limit(0), docs.select(docs.doc_id.alias("item_id"), "text")).collect() == []


# exact top-k


@pytest.mark.parametrize("block,queries", [(8192, 8192), (50, 2)])
def test_topk_against_brute_force(spark, monkeypatch, block, queries):
    monkeypatch.setattr(bitslice, "BLOCK", block)
    monkeypatch.setattr(bitslice, "QUERIES", queries)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(150)]
    rows += [(i + 200, rows[i][1]) for i in range(20)]  # ties
    rows += [(300, None), (350, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [0.0] * 6), (550, [1.0, 2.0]), (None, [1.0] * 6), (600, []), (650, [1e5, -1e5, 3e4, 0.0, 1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, a in usable:
        if q % 50 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b)))[:5]
            want |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    assert {tuple(r) for r in bitslice.search_digest(df).collect()} == want


def test_topk_of_huge_components(spark):
    rows = [(i, [float(i % 7 - 3), 0.5 * i]) for i in range(1, 60)] + [(100, [1e20, 0.0]), (150, [0.0, -1e15]), (200, [-1e20, 1e300]), (250, [1e307, 0.0]), (300, [4e9, 4e9]), (350, [4e9, -4e9]), (400, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if np.isfinite(256 * np.array(v)).all()]
    assert len(usable) == len(rows) - 1
    most = (1 << 63) - 1
    want = set()
    for q, a in usable:
        if q % 50 == 0:
            scored = [(max(-most, min(most, s)), float(max(-bitslice.LARGEST, min(bitslice.LARGEST, s))), i) for i, b in usable if i != q for s in [sum(x * y for x, y in zip(a, b))]]
            scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
            want |= {(q, n, i, s) for n, (s, _, i) in enumerate(scored[:5], 1)}
    assert {tuple(r) for r in bitslice.search_digest(df).collect()} == want


def test_topk_of_nothing(spark):
    assert bitslice.search_digest(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []
