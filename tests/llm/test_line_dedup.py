import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from facetry.llm import line_dedup
from facetry.llm.line_dedup import NO_ID, CuckooFilter, LineIndex, dedup_digest, drop_lines

BLANKS = " \t\n\x0b\x0c\r"
LONG = "this line is long enough to count as a repeated line"


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(BLANKS).translate(low)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(NO_ID if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        me = NO_ID if doc is None else doc
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 5 and max(holders[key(x)]) != me)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rows = [(i, f"{LONG}\nown line of {i}\n  {LONG.upper()}\t") for i in range(7)]
    rows += [(i, f"only four documents hold this line, which is long\n{i}") for i in range(10, 14)]
    rows += [(20 + i, "é" * 40 + "\r") for i in range(5)] + [(30 + i, "é" * 39) for i in range(6)]
    rows += [(50, None), (51, ""), (None, LONG), (52, "\n\n"), (53, "x" * 200_000), (53, "x" * 200_000)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id bigint, text string, keys string, n_lines int")
    assert sorted(map(tuple, dedup_digest(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert dedup_digest(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def state(index):
    return [sorted(map(tuple, t.collect()), key=str) for t in (index.postings, index.counts.select("shard", "k1", "k2", "n_docs", "last_doc"))]


def test_delete_reverses_insert(spark):
    first = spark.createDataFrame([(i, f"{LONG}\nline {i % 3} that several of these documents share, too") for i in range(9)], "doc_id bigint, text string")
    second = spark.createDataFrame([(i, f"line {i % 3} that several of these documents share, too") for i in range(100, 109)], "doc_id bigint, text string")
    before = LineIndex.build(first)
    after = before.insert(second)
    assert after.counts.filter("n_docs = 6").count() == 3
    assert {r[0]: r.n_dropped for r in drop_lines(second, after).collect()} == {i: int(i < 106) for i in range(100, 109)}
    undone = after.delete(second.select("doc_id"))
    assert state(undone) == state(before)
    known = {(r.k1, r.k2) for r in undone.maybe_repeated().collect()}
    assert {(r.k1, r.k2) for r in undone.counts.filter("n_docs >= 5").collect()} <= known
    assert len(known) == 1  # the deleted keys left the filter, too


def test_built_is_inserted(spark):
    rows = corpus()[:-6]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = LineIndex.build(df)
    grown = LineIndex.build(df.filter("doc_id < 4")).insert(df.filter("doc_id >= 4"))
    assert state(grown) == state(whole)


def test_filters_by_shard(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 50)
    rows = [(i, "\n".join(f"line {j} of many, which several of the documents hold" for j in [*range(60), 1000 + i] if (i * j) % 4 == 0 or j > 60)) for i in range(40)]
    index = LineIndex.build(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert index.shards > 3
    want = sorted(map(tuple, index.maybe_repeated().collect()))
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 0)
    assert sorted(map(tuple, index.maybe_repeated().collect())) == want and 0 < len(want) < index.postings.count()
    assert sorted(map(tuple, dedup_digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str) == brute(rows)


def test_held_documents_are_not_inserted_again(spark):
    df = spark.createDataFrame([(i, LONG) for i in range(6)], "doc_id bigint, text string")
    index = LineIndex.build(df)
    with pytest.raises(ValueError, match="already"):
        index.insert(df.limit(2))
    assert state(index.delete(df.filter("doc_id < 2").select("doc_id")).insert(df.filter("doc_id < 2"))) == state(index)


def test_many_changes_are_merged(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(line_dedup, "LAYERS", 2)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    line = lambda j: f"line {j} of many, which several of the documents hold"
    part = lambda at: spark.createDataFrame([(i, "\n".join(line(j) for j in range(i % 30))) for i in range(at, at + 10)], "doc_id bigint, text string")
    index = LineIndex.build(part(0))
    for at in (10, 20, 30):
        index = index.insert(part(at))
    index = index.delete(part(10).select("doc_id"))
    whole = LineIndex.build(part(0).union(part(20)).union(part(30)))
    counts = lambda x: sorted(map(tuple, x.counts.drop("shard").collect()))
    assert counts(index) == counts(whole) and index.layers < 2 and index.shards > 1
    index.save(str(tmp_path / "index"))
    back = LineIndex.load(spark, str(tmp_path / "index"))
    assert (back.shards, back.min_docs) == (index.shards, index.min_docs)
    drops = lambda x: sorted((r.doc_id, sorted(map(tuple, r["keys"]))) for r in x.drops().collect())
    assert drops(back) == drops(whole) == drops(index)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_cuckoo_filter(n):
    random.seed(1)
    keys = np.array([random.getrandbits(64) - (1 << 63) for _ in range(n)], np.int64)
    made = CuckooFilter.of(keys)
    assert made.contains(keys).all()
    made.delete(keys[: n // 2])
    assert made.contains(keys[n // 2 :]).all()
    other = np.array([random.getrandbits(64) - (1 << 63) for _ in range(2000)], np.int64)
    assert made.contains(other).mean() < 0.01
    made.delete(keys[n // 2 :])
    assert not made.slots.any()
