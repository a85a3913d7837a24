import random
import re
import time
from itertools import product

import numpy as np
import pytest

from facetry.llm import license_scan as L
from facetry.llm import secret_crf as S


def test_pieces_rebuild_the_notice():
    for notice in L.NOTICES:
        parts = L.pieces(notice)
        assert "".join(p for _, p in parts) == notice and len(parts) == L.errors_of(notice) + 1


def test_license_base_against_brute_force(spark):
    texts = ["All rights reserved. CC-BY and cc by", None, "", "general, public\nLICENSE all rights", "x" * 100_000 + " all rights reserved", "éall rights reserved"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(0, texts[0], "z")], "doc_id bigint, text string, labels string")
    got = sorted(L.license_digest(df).collect(), key=str)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for row in got:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[row.doc_id] or "").translate(low))
        places = sorted((i, label) for p, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert row.n_words == len(words) and row.n_base == len(places)
        assert row.first_word == (places[0][0] if places else None) and row.last_word == (places[-1][0] if places else None)
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(row.base_labels.split(",")) <= {*row.labels.split(","), ""} and 0 <= row.score <= 1
    assert len(got) == 7


def test_license_with_errors(spark):
    text = "Intro. Licensd under the Apache-Licence, Versoin 2.0! More. All rigths reserved"
    found = L.scan(text.encode())
    assert {s["label"] for s in found["spans"]} == {"apache-2.0", "reserved"} and not found["base"]
    for s in found["spans"]:
        assert 0 < s["errors"] <= 5
        assert text[s["start"] : s["stop"]].lower().startswith(("licensd", "all"))
    assert L.scan(b"nothing to see here, right?")["spans"] == []
    assert [s["label"] for s in L.scan(b"licensed under cc by-nc 4.0")["spans"]] == ["cc-by-nc-4.0"]


def test_gpl_without_gnu():
    found = L.scan(b"Under the General Public Licence of old")
    assert [(s["label"], s["errors"]) for s in found["spans"]] == [("gpl", 1)] and found["score"] > 0.9
    # where a longer notice stands, it alone is told
    for text, label in ((b"GNU General Public License", "gpl"), (b"the GNU Leser General Public License", "lgpl"), (b"GNU Affero General Public Licence", "agpl")):
        assert [s["label"] for s in L.scan(text)["spans"]] == [label]


def test_words_that_tell_licences_apart():
    for text, labels in (
        ("licensed under the bsd license", {"bsd"}),
        ("licensed under the gpl license", set()),
        ("licensed under the isc license", {"isc"}),
        ("licensed under the MIT licence", {"mit"}),
        ("cc by 3.0", set()),
        ("licensed under cc by-sa 4.0", {"cc-by-sa-4.0"}),
        ("mozilla public license v 1.1", set()),
        ("mozila public license v 2.0", {"mpl-2.0"}),
        ("apache license version 1 1", set()),
        ("apache license, Version 2.0", {"apache-2.0"}),
        ("small rights reserved", set()),
        ("call rights reserved", set()),
        ("no rights reserved", {"cc0"}),
    ):
        assert {s["label"] for s in L.scan(text.encode())["spans"]} == labels, text


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_places(flat, notice):
    """{(start, end): fewest edits} of every run of whole words that the rule accepts, by edit-distance tables."""
    parts, k = L.parts_of(notice), L.errors_of(notice)
    found = {}
    for start in (i + 1 for i, c in enumerate(flat) if c == " "):
        ends = {start: 0}
        for n, (part, most) in enumerate(parts):
            new = {}
            for at, cost in ends.items():
                if n:
                    if flat[at : at + 1] != " ":
                        continue
                    at += 1
                for stop in range(at + max(0, len(part) - most), min(len(flat), at + len(part) + most) + 1):
                    own = edits(part, flat[at:stop])
                    if own <= most and cost + own <= k:
                        new[stop] = min(new.get(stop, k), cost + own)
            ends = new
        found |= {(start, stop): cost for stop, cost in ends.items() if flat[stop : stop + 1] == " "}
    return found


@pytest.mark.parametrize("notice", L.NOTICES)
def test_notices_against_edit_distance_tables(notice):
    rng = random.Random(notice)
    k = L.errors_of(notice)
    for changes in [*range(k + 3), *range(k + 1)]:
        text = list(notice)
        for _ in range(changes):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice([[], [rng.choice("etaoin ")], [text[at], rng.choice("etaoin")]])
        _, flat = L.normal(" ".join(rng.choices(["the", "public", "license", "all", "and", "x"], k=4) + ["".join(text)] + rng.choices(["v", "rights", "2", "free"], k=4)).encode())
        want = brute_places(flat.decode(), notice)
        got = [x for x in L.notice_places(flat.decode()) if x[2] == notice]
        assert bool(got) == bool(want), flat
        for start, end, _, cost in got:
            assert cost == want.get((start, end), -1), flat


def test_many_notices_take_time_in_proportion():
    text = " ".join(f"All rigths reserved, cc by {i}" for i in range(20_000)).encode()
    start = time.perf_counter()
    found = L.scan(text)
    assert len(found["spans"]) == len(found["base"]) == 20_000 and time.perf_counter() - start < 20
    assert found["spans"][-1]["first_word"] == 6 * 19_999 and found["base"][-1] == (6 * 19_999 + 3, "cc-by")


SECRETS = [f"the key of the shop is password={i:018x} and so the day goes on with words" for i in range(12, 90)]
PLAIN = [f"order {i} of 20{i} costs {i * 7}.50 at www.shop{i}.com for mr smith and the rest" for i in range(12, 90)]


def brute_base(text):
    text = text or ""
    found = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], ("assign", "access", "hex").index(x[2])))


def test_secret_base_and_field(spark):
    import hashlib

    hard = [None, "", 'ToKeN : "abcdefgh1"', "Kpassword=short", "é AKIA" + "B" * 16 + " " + "0a" * 20, "token=" + "0a" * 16, "paſſword=abcdefghij", "x" * 50_000 + " secret=abcdefgh"]
    texts = SECRETS + PLAIN + hard
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id bigint, text string")
    for row in S.secret_digest(df).collect():
        text = texts[row.doc_id or 0]
        base = brute_base(text)
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(k == x[2] for x in base) for k in S.KINDS]
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        spans = [s for s in row.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def trained():
    samples = [w for t in SECRETS[:60] + PLAIN[:60] for w in S.labelled_windows(t, t.encode())]
    return S.fit(samples)


def test_field_on_held_out_texts():
    field = trained()
    hit = sum(any(a <= t.index("=") + 1 < b for a, b in field.spans(t)) for t in SECRETS[60:])
    wrong = sum(bool(field.spans(t)) for t in PLAIN[60:])
    assert hit >= 16 and wrong <= 1
    bare_secret = "the password is 00000000deadbeef99 they say and nobody minds it at all"
    assert field.spans(bare_secret)  # no assignment sign, so no base span


def test_pruned_decoding_is_exact():
    field = trained()
    whole = S.Field(field.weights, field.moves)
    whole.prunes = False
    assert field.prunes
    for text in SECRETS[:5] + PLAIN[:5] + ["", "no digits at all", "a " * 300 + "password = 77ab77ab77ab " + "b " * 300]:
        assert field.spans(text) == whole.spans(text)


def test_emissions_are_the_features_weights():
    field = trained()
    for text in SECRETS[:10] + PLAIN[:10] + ["", "a=b", "token: AbCdEf0123456789AbCdEf é—ß 12 0xff" + " x" * 9]:
        tokens = S.TOKEN.findall(text)
        if not tokens:
            continue
        file = S.file_features(tokens)
        (got,) = field.emissions(tokens, [(0, len(tokens))], file)
        for i, row in enumerate(got):
            want = sum((field.weights.get(f, np.zeros(3)) for f in S.features(tokens, i, file)), np.zeros(3))
            assert np.allclose(row, want), (text, i)


def test_viterbi_against_enumeration():
    rng = np.random.default_rng(5)
    field = S.Field({}, rng.normal(size=(3, 3)))
    emits = [rng.normal(size=(n, 3)) for n in (4, 1, 6, 2, 6)]
    for emit, tags in zip(emits, field.viterbi(emits)):
        def score(path):
            full = [S.OUTSIDE, *path, S.OUTSIDE]
            return sum(emit[i, t] for i, t in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(full, full[1:]))

        assert tags.tolist() == list(max(product(range(3), repeat=len(emit)), key=score))


def test_long_windows_are_cut_not_dropped():
    dense = " ".join(f"k{i}={i}" for i in range(200)) + " password=" + "ab12" * 500
    parts = S.labelled_windows(dense, dense.encode())
    assert len(parts) > 5 and all(len(t) <= S.WINDOW and max(map(len, t)) <= S.TOKEN_CHARS for t, _, _ in parts)
    assert sum(len(t) for t, _, _ in parts) == len(S.TOKEN.findall(dense)) and any(S.BEGIN in m for _, m, _ in parts)


def test_rare_secrets_are_learnt(spark, monkeypatch):
    """Secrets outside the sampled documents train the field, too; other columns' names don't matter."""
    monkeypatch.setattr(S, "SAMPLE_DOCS", 20)
    rows = [(i, t, "x", 1) for i, t in enumerate(["plain words only here"] * 3000 + SECRETS[:40] + PLAIN[:40])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, base string, spans int")
    field = S.train(df)
    assert field is not None and len(S.secret_scan(df, field).filter("size(base) > 0").collect()) == 40


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    emit, moves = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    tags, pairs = S.marginals(emit, moves, np.ones((1, 4), bool))
    total, expected, steps = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in product(range(3), repeat=4):
        full = [S.OUTSIDE, *path, S.OUTSIDE]
        p = np.exp(sum(emit[0, i, t] for i, t in enumerate(path)) + sum(moves[a, b] for a, b in zip(full, full[1:])))
        total += p
        for i, t in enumerate(path):
            expected[i, t] += p
        for a, b in zip(full, full[1:]):
            steps[a, b] += p
    assert np.allclose(tags[0], expected / total) and np.allclose(pairs, steps / total)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert L.license_digest(empty).collect() == [] and S.secret_digest(empty).collect() == []
