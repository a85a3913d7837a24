import zlib
from collections import Counter
from itertools import product
from math import lgamma, log, log10

import numpy as np
import pytest

import corpus_pipeline
from facetry.llm import ctw, decontam, mixing, shuffle_shards, simhash, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# sharding


def test_fisher_yates_is_a_seeded_permutation():
    for n in (0, 1, 2, 1000):
        order = shuffle_shards.fisher_yates(n, 1, 2)
        assert sorted(order.tolist()) == list(range(n)) and order.tolist() == shuffle_shards.fisher_yates(n, 1, 2).tolist()
    seen = Counter(tuple(shuffle_shards.fisher_yates(3, 5, b).tolist()) for b in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


@pytest.mark.parametrize("n", [0, 1, 100])
def test_shards(spark, n):
    rows = [(i, None if i % 9 == 0 else "é" * (i % 50), "x") for i in range(n)] + [(None, "no id", "x"), (5, "again", "y"), (5, "again", "y")] * bool(n)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, size string")
    got = shuffle_shards.shard_digest(df).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in rows if d is not None)
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and (not got or max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1)
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sorted(map(str, got)) == sorted(map(str, shuffle_shards.shard_digest(df.repartition(3)).collect()))


def test_shards_written(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id bigint, text string")
    shuffle_shards.write_shards(df, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in df.collect())


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, f"w {i}", "s", "a", 1, 2.0, i) for i in range(30)], "doc_id bigint, text string, source string, shard string, mix_size int, __copy double, _bucket int")
    sharded = shuffle_shards.shuffle_into_shards(df)
    assert dict(sharded.dtypes)["shard"] == "int" and sorted(r._bucket for r in sharded.collect()) == list(range(30))
    mixed = mixing.mix(df)
    assert mixed.dtypes == df.dtypes and {r.mix_size for r in mixed.collect()} == {1} and mixed.count() == 30


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in full else share[s] for s in names}
        full |= over


def test_mix_against_brute_force(spark):
    rng = np.random.default_rng(8)
    sources = ["big"] * 400 + ["tiny", "Ärger", "b", "c", None, None, "zero"] + ["d"] * 60
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 40))), s) for i, s in enumerate(sources)]
    rows[406] = (406, None, "zero")
    rows += [(None, "\x0b one\x1ctwo \t three\n", "b"), (3, rows[3][1], "big")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, source string, size string")
    got = mixing.mix_digest(df).collect()
    count = lambda t: len([w for w in (t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w])
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    want = brute_targets(sizes)
    by_id = {d: (t, s) for d, t, s in rows}
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        t, s = by_id[r.doc_id]
        assert r.size == count(t) and r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=1e-6)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        assert r.size == 0 or abs(r.taken / r.size - want[s] / sizes[s]) < 1
        taken[s] += r.taken
    assert taken["big"] == pytest.approx(want["big"], rel=0.1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(df).collect()))
    assert mixing.mix(df).count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix_digest(df.limit(0)).collect() == []


def test_repeated_rows_draw_apart(spark, tmp_path):
    import duckdb

    rows = [(7, "one two three", "a")] * 700 + [(None, "one two three", "a")] * 300 + [(i, "w " * 10, "b") for i in range(400)] + [(5, None, "a"), (5, "", "a"), (5, "\tx  y\n", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix_digest(df.repartition(7)).collect()
    assert len(got) == len(rows)
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.05)
    assert len({r.taken for r in got if r.doc_id == 7 and r.size == 3}) == 2
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_digest(df.repartition(3)).collect()))
    assert mixing.mix(df).count() == pytest.approx(sum(r.taken // r.size for r in got if r.size), abs=3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.MIX_SQL).fetchall()
    shown = lambda rs: sorted((str(d), s, z, round(t, 6), n) for d, s, z, t, n in rs)
    assert shown(map(tuple, got)) == shown(want)


def test_word_counts_of_long_texts(spark):
    texts = ["w " * 500_000, " " * 100_000, "x" * 300_000, "a\u00a0b\x0bc\x85d"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.mix_size for r in mixing.measure(df).orderBy("doc_id").collect()] == [500_000, 0, 1, 2]


def test_hot_rows_are_scattered(spark):
    rows = [(1, "same text")] * 3000 + [(2, f"text {i}") for i in range(3000)] + [(None, None)] * 3000
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = shuffle_shards.shuffle_into_shards(df.repartition(5), bucket_bytes=20_000)
    assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(str(r) for r in df.collect())
    places = [r.shard + 8 * r.slot for r in got.collect()]
    assert sorted(places) == list(range(9000))
    for key in (1, 2, None):  # no stretch of the order belongs to one id
        own = sorted(r.slot * 8 + r.shard for r in got.collect() if r.doc_id == key)
        assert max(b - a for a, b in zip(own, own[1:])) < 60
    assert sorted(map(str, got.collect())) == sorted(map(str, shuffle_shards.shuffle_into_shards(df.repartition(2), bucket_bytes=20_000).collect()))


def test_very_long_texts_are_sharded(spark):
    df = spark.createDataFrame([(i, "é" * (3_000_000 if i % 7 == 0 else 3)) for i in range(20)], "doc_id bigint, text string")
    got = shuffle_shards.shuffle_into_shards(df, bucket_bytes=1 << 20).collect()
    assert {(r.doc_id, len(r.text)) for r in got} == {(i, 3_000_000 if i % 7 == 0 else 3) for i in range(20)}


# toxicity


def test_toxicity_on_held_out(spark):
    rng = np.random.default_rng(6)
    words = ["stone", "river", "cloud", "garden", "paper", "winter", "market", "silver"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 30))
        toxic = int(i % 5 == 0)
        if toxic:
            text.insert(int(rng.integers(0, 30)), str(rng.choice(["dreckskerl", "blockhead"])))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    rows += [(900, None), (901, ""), (None, "river"), (902, "x" * 100_000), (0, rows[0][1])]
    labels += [(0, 1, 1), (None, 0, 1), (950, 0, None), (5, None, 0)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, score int")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    truth = {i: t for i, _, t in labels[:600]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and all(r.predicted == truth[r.doc_id] for r in held)
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def brute_grams(text):
    """Distinct character n-grams, and for each the cell by definition."""
    flat = " " + " ".join((text or "").translate({**{c: c + 32 for c in range(65, 91)}, **{c: 32 for c in (9, 10, 11, 12, 13)}}).split(" ")) + " "
    while "  " in flat:
        flat = flat.replace("  ", " ")
    if flat == " ":
        flat = "  "
    cells = {}
    for order in toxicity.ORDERS:
        for at in range(len(flat) - order + 1):
            value = order
            for c in flat[at : at + order]:
                value = (value * 0x01000193 + ord(c)) % (1 << 32)
            cells[flat[at : at + order]] = value * 0x9E3779B1 % (1 << 32) >> 32 - toxicity.HASH_BITS
    return cells


def test_toxicity_against_brute_force(spark):
    rng = np.random.default_rng(12)
    words = ["Stein", "Fluß", "слово", "дом", "雨が降る", "garden", "été", "𝔘𝔫", "a", "blockhead"]
    texts = [" \t".join(rng.choice(words, int(rng.integers(1, 12)))) for _ in range(120)] + ["", None, "x"]
    marks = [int("blockhead" in (t or "")) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    grams = [brute_grams(t) for t in texts]
    for t, g in zip(texts, grams):
        found = toxicity.cells_of((t or "").encode())
        assert set(np.concatenate(found).tolist() if found else []) == set(g.values())
    training = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5]
    counts = Counter((c, marks[i]) for i in training for c in set(grams[i].values()))
    rows = toxicity.labelled(docs, toxicity.training_labels(labels), True, ("text",))
    assert {(r.cell, m): n for r in toxicity.cell_counts(rows).collect() for m, n in ((1, r.positive), (0, r.negative)) if n} == dict(counts)
    n = Counter(marks[i] for i in training)
    share = n[1] / (n[0] + n[1])
    model = toxicity.train(docs, labels)
    cells = sorted({c for c, _ in counts})
    ratio = toxicity.log_ratios(*(np.array([counts[c, m] for c in cells]) for m in (1, 0)), n[1], n[0])
    for c, r in zip(cells, ratio):
        assert r == pytest.approx(log((counts[c, 1] + 2 * share) / (n[1] + 2)) - log((counts[c, 0] + 2 * (1 - share)) / (n[0] + 2)))
    # weights are multiples of the ratio: they vanish with it and nothing but features has one
    assert set(np.flatnonzero(model.table).tolist()) <= set(cells)
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    for i, g in enumerate(grams):
        total = model.bias + sum(float(model.table[c]) for c in set(g.values()))
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-6)


def test_regression_reaches_its_optimum():
    """Against plain gradient descent on the same loss, by definition."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.5)
    y = (x @ np.array([2.0, -1, 0.5, 0, 0]) + rng.normal(size=60) > 0).astype(float)
    rows, cols = np.nonzero(x)
    weights, bias = toxicity.fit_logistic(cols, rows, x[rows, cols], y, 5)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w, b):
        return -(share * np.log(1 / (1 + np.exp(-(2 * y - 1) * (x @ w + b))))).sum() + toxicity.RIDGE / 2 * (w * w).sum()

    w, b = np.zeros(5), 0.0
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w, b = w - 0.5 * (x.T @ error + toxicity.RIDGE * w), b - 0.5 * error.sum()
    assert loss(weights, bias) == pytest.approx(loss(w, b), rel=0.02)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.5, 0.5]
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


# context-tree weighting


def brute_ctw(texts, scored):
    """log10 probability of ``scored`` from definitions: recursive weighting of every context."""
    depth = ctw.DEPTH
    counts = {}
    for text in texts:
        data = b"\n" * depth + text + b"\0"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context = data[i - d : i]
                for bit in range(8):
                    node = (d, context, bit, data[i] >> 8 - bit)
                    counts.setdefault(node, [0, 0])[data[i] >> 7 - bit & 1] += 1
    kt = lambda z, o: lgamma(z + 0.5) + lgamma(o + 0.5) - 2 * lgamma(0.5) - lgamma(z + o + 1)
    kids = {}
    for d, context, bit, prefix in counts:
        if d:
            kids.setdefault((d - 1, context[1:], bit, prefix), []).append((d, context, bit, prefix))
    weighted = {}
    for node in sorted(counts, key=lambda n: -n[0]):
        own = kt(*counts[node])
        weighted[node] = own if node[0] == depth else np.logaddexp(own, sum(weighted[k] for k in kids.get(node, ()))) - log(2)

    def one(context, bit, prefix, d=0):
        node = (d, context[len(context) - d :] if d else b"", bit, prefix)
        if node not in counts:
            return 0.5
        z, o = counts[node]
        own = (o + 0.5) / (z + o + 1)
        if d == depth:
            return own
        stop = np.exp(kt(z, o) - log(2) - weighted[node])
        return stop * own + (1 - stop) * one(context, bit, prefix, d + 1)

    out = []
    for text in scored:
        data, total = b"\n" * depth + text + b"\0", 0.0
        for i in range(depth, len(data)):
            for bit in range(8):
                p = one(data[i - depth : i], bit, data[i] >> 8 - bit)
                total += log10(p if data[i] >> 7 - bit & 1 else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("pieces", [2_000_000, 40])
def test_ctw_and_base_against_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(ctw, "PIECE_KEYS", pieces)
    monkeypatch.setattr(ctw, "TABLE_KEYS", 2 * pieces)
    monkeypatch.setattr(ctw, "TOP_WORDS", 3)
    monkeypatch.setattr(ctw, "SEGMENT", 64)
    texts = ["the cat sat on the mat", "The dog sat", None, "", "abracadabra " * 12, "ünïcode the\tcat\x0b", "qqq", "the cat sat on the mat", "zz top the", "on on on"] * 2
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "the cat", 1)], "doc_id bigint, text string, score int")
    low = [(t or "").encode().translate(ctw.ASCII_LOWER) for t in texts]
    training = [t for i, t in enumerate(low) if zlib.crc32(str(i).encode()) % 10]
    tokens = Counter()
    for t in training:
        tokens.update([*t.split(), None])
    n, v = sum(tokens.values()), len(tokens)
    got = {r.doc_id: r for r in ctw.score_documents(df).collect()}
    assert len(got) == len(texts) + 1 and got[None].held_out
    for i, want in enumerate(brute_ctw(training, low)):
        r, own = got[i], [*low[i].split(), None]
        assert r.score == pytest.approx(want, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(tokens[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))


def test_ctw_is_a_distribution_over_bytes():
    texts = [b"abab", b"abba", b"cab"]
    keys, n = np.unique(np.concatenate([k for _, _, k in ctw.keyed_segments(texts)]), return_counts=True)
    top = ctw.Top()
    top.add(ctw.levels_of(keys, n.astype(float))[-1])
    top.finish()
    piece = ctw.Piece(0, 1 << 16, keys, n.astype(float), top)
    for context in (b"\n\nab", b"zzzz", b"xxab"):
        base = sum(c << 8 * (ctw.DEPTH - i) for i, c in enumerate(reversed(context)))
        assert (10.0 ** piece.scores(np.array([base | s for s in range(256)], np.uint64))).sum() == pytest.approx(1)


def test_ctw_of_nothing(spark):
    assert ctw.score_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = ctw.score_documents(spark.createDataFrame([(held, "ab")], "doc_id bigint, text string")).collect()
    assert (row.train_tokens, row.n_known, row.n_tokens) == (0, 0, 2) and row.score == pytest.approx(-24 * log10(2))


# the pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [a + b for a, b in product(["sto", "riv", "clo", "gar", "pap", "win"], ["ne", "er", "ud", "den"])]
    item = " ".join(rng.choice(words, 25))
    rows = []
    for i in range(240):
        text = list(rng.choice(words, 60))
        if i % 6 == 0:
            text.insert(5, "blockhead")
        if i % 10 == 1:
            text[20:45] = item.split()
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 1))
    rows += [(300 + i, rows[2][1], "en", "s0", 1) for i in range(20)] + [(400, None, None, None, None)]
    tables = {
        "documents": spark.createDataFrame(rows, DOCS),
        "labels": spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, item)], "item_id bigint, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    scores = toxicity.toxicity(tables["documents"], tables["labels"]).collect()
    clean = {r.doc_id for r in scores if not r.predicted}
    left = [r for r in rows if r[0] in clean]
    assert not any(r[0] % 6 == 0 and r[0] < 240 for r in left)
    heads = {r.doc_id for r in simhash.simhash_components(spark.createDataFrame(left, DOCS)).collect() if r.component_id == r.doc_id}
    left = [r for r in left if r[0] in heads]
    held = {r.doc_id for r in decontam.overlaps(spark.createDataFrame(left, DOCS), tables["benchmark"]).collect()}
    left = [r for r in left if r[0] not in held]
    assert not any(i % 10 == 1 for i, *_ in left) and sum(r[1] == rows[2][1] for r in left) == 1
    copies = Counter({r.doc_id: r.taken // r.size if r.size else None for r in mixing.mix_digest(spark.createDataFrame(left, DOCS)).collect()})
    seen = Counter(r.doc_id for r in got)
    assert all(seen[d] == n for d, n in copies.items() if n is not None) and set(seen) <= {r[0] for r in left}
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_pipeline_of_null_and_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(19)
    words = [a + b for a, b in product(["sto", "riv", "clo", "gar", "pap", "win"], ["ne", "er", "ud", "den", "mi"])]
    text = lambda *more: " ".join([*rng.choice(words, 40), *more])
    item = " ".join(rng.choice(words, 20))
    rows = [(i, text(*["blockhead"] * (i % 4 == 0)), "en", "s", 1) for i in range(200)]
    clean = [(None, text(), "en", "s", 1), (7000, text(), "en", "s", 1), (7000, text(), "en", "s", 1), (None, text(), None, "s", None)]
    copies = [(None, clean[0][1], "en", "s", 1), (7000, clean[1][1], "en", "s", 1), (7001, clean[2][1].upper(), "en", "s", 1)]
    dirty = [(None, text("blockhead"), "en", "s", 1), (7000, text("blockhead"), "en", "s", 1), (None, f"{text()} {item} {text()}", "en", "s", 1), (7000, f"{text()} {item.title()}", "en", "s", 1)]
    tables = {
        "documents": spark.createDataFrame([*rows, *clean, *copies, *dirty, (None, None, None, "s", None), (8000, "", "en", "s", 0)], DOCS),
        "labels": spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, item), (1, "win"), (2, None)], "item_id bigint, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, left = tables["documents"], []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    left = Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(left[d, t] == 1 for d, t, *_ in clean)  # one of each group, whatever its id
    assert not any(t and ("blockhead" in t or item in t.lower()) for _, t in left) and (7001, copies[2][1]) not in left
    assert sum(1 for d, t in left if not t) == 1 and sum(left.values()) == sum(1 for r in rows if r[0] % 4) + len(clean) + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.text) for r in got} <= set(left) and sorted(r.shard + 8 * r.slot for r in got) == list(range(len(got)))
    empty = tmp_path / "empty"
    for name, df in tables.items():
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
