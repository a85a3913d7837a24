"""Secret scan: fixed patterns, and a linear-chain conditional random field for the rest.

The field tags a text's tokens (runs of letters and digits, other characters one by one)
as secret begin, inside or outside. Features are a token's shape, the words beside it
and features of the file; tags are decoded by Viterbi. It is trained here. The fixed
patterns label every document; fitted by gradient ascent on the conditional likelihood
are at most ``TRAIN_WINDOWS`` windows, in the order of a hash: half of them from all
documents with secrets, the others from about ``SAMPLE_DOCS`` documents chosen by a hash of
the id. A window of more than ``WINDOW`` tokens is cut into parts of that size, and of a
token at most ``TOKEN_CHARS`` characters are kept for training, so that what is collected
is bounded. In half of the labelled windows the assignment sign is hidden, so that the
field also learns secrets that no pattern reaches.

Whole texts are decoded without scoring every plain word: a token of letters only (no
key word, no ``LONG`` letters) or one character whose neighbours within ``REACH`` are plain
too has one feature only. If the lead of "outside" under it exceeds what the two
transitions around any other tag can gain, setting such tokens to outside one by one only
improves a path, so they are outside in every best path and the runs between them can be
decoded one by one, with the same tags as one long decoding. The lead is read off the
trained weights (``plain_lead``); where it is too small, all tokens are decoded.

Spans of the field that meet no base span are added under the kind ``field``; base spans
always stay. Places are code points, ends exclusive.

Edge cases: null and empty texts have no spans; without labelled windows the field adds
nothing; repeated rows are each returned; a null id is returned as null and trains
nothing; an empty table gives an empty result; extra columns are ignored; texts of any
length are decoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, map_batches, settle, text_bytes

#: Fixed by the contract.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

SAMPLE_DOCS = 6000
TRAIN_WINDOWS = 3000
WINDOW = 60
TOKEN_CHARS = 64
ROUNDS = 80
LONG = 20
#: Tokens whose shapes are remembered at a time.
REMEMBERED = 1 << 16
REACH = 2
LABELS = 3
BEGIN, INSIDE, OUTSIDE = range(LABELS)
KEY_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "key", "api", "apikey", "auth", "bearer", "credential", "credentials", "private", "access")
_KEYS = {v: w for w in KEY_WORDS for v in (w, w.title(), w.upper())}
TOKEN = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+|[^\sA-Za-z0-9]")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = []
    lower = raw.translate(ASCII_LOWER)
    if any(w in lower for w in _ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def is_plain(token: str) -> bool:
    return (token.isalpha() and len(token) < LONG and token not in _KEYS) or len(token) == 1


def kind_of(token: str) -> str:
    """Shape class."""
    if token in _KEYS:
        return "key"
    if len(token) == 1 and not token.isalpha():
        return "digit" if token.isdigit() else "mark" if token not in "=:\"'-_./+" else token
    if token.isalpha():
        kind = "lower" if token.islower() else "upper" if token.isupper() else "title" if token[1:].islower() else "mixed"
        return f"long-{kind}" if len(token) >= LONG else kind
    if token.isdigit():
        return "digits"
    if re.fullmatch("[0-9a-f]+", token):
        return "hex"
    if re.fullmatch("[0-9A-Z]+", token):
        return "caps"
    return "alnum"


#: All kinds; "edge" is what lies beyond the text.
KIND_NAMES = ("edge", "key", "digit", "mark", *"=:\"'-_./+", *(f"{x}{y}" for x in ("", "long-") for y in ("lower", "upper", "title", "mixed")), "digits", "hex", "caps", "alnum")
_KIND_AT = {k: i for i, k in enumerate(KIND_NAMES)}
#: The only feature of a plain token among plain ones.
FLAT = "flat|plain"
#: Templates of any other token.
TEMPLATES = 9
SIZES, TURNS, FILES = 11, 6, 6


def size_of(token: str) -> int:
    return min(SIZES - 1, len(token) // 4)


def turns_of(token: str) -> int:
    """Changes between letters and digits, at most 5."""
    return min(TURNS - 1, sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:])))


_SHAPES: dict[str, tuple[int, int, int, bool]] = {}


def shape_of(token: str) -> tuple[int, int, int, bool]:
    """(place of its kind, size, turns, whether it is plain)."""
    known = _SHAPES.get(token)
    if known is None:
        known = _KIND_AT[kind_of(token)], size_of(token), turns_of(token), is_plain(token)
        if len(token) <= TOKEN_CHARS:
            if len(_SHAPES) >= REMEMBERED:
                _SHAPES.clear()
            _SHAPES[token] = known
    return known


def file_features(tokens: list[str]) -> int:
    """A class of the whole text: does it name keys, are digits frequent."""
    special = [t for t in tokens if not is_plain(t)]
    keys = any(t in _KEYS for t in special)
    numbers = sum(not t.isalpha() for t in special)
    return 3 * keys + min(2, numbers * 50 // (len(tokens) + 1))


def features(tokens: list[str], at: int, file: int) -> list[str]:
    """Feature names of a token; templates are the text before the first '|'."""

    def near(k: int) -> str:
        i = at + k
        return kind_of(tokens[i]) if 0 <= i < len(tokens) else "edge"

    if all(is_plain(t) for t in tokens[max(0, at - REACH) : at + REACH + 1]):
        return [FLAT]
    token = tokens[at]
    own = near(0)
    shape = own if is_plain(token) else f"{own}|{size_of(token)}"
    before, before2, after, after2 = near(-1), near(-2), near(1), near(2)
    return [
        f"own|{own}",
        f"shape|{shape}",
        f"turns|{own}|{turns_of(token)}",
        f"before|{before}",
        f"before2|{before2}",
        f"after|{after}",
        f"after2|{after2}",
        f"key|{'key' in (before, before2)}|{own}",
        f"file|{file}|{own}",
    ]


class Field:
    """Weights: three a feature, and transitions [from, to]; the state before and after is outside.

    For decoding, each template's weights are a table by the numbers of ``shape_of``."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        # most that a path gains in transitions by another tag than outside, between any two tags
        gains = moves[:, None, :] + moves.T[None, :, :] - moves[:, OUTSIDE][:, None, None] - moves[OUTSIDE][None, :, None]
        self.prunes = self.plain_lead() > gains[:, :, :OUTSIDE].max()
        none = np.zeros(LABELS)
        one = lambda name: weights.get(name, none)
        self.flat = one(FLAT)
        self.near = {t: np.array([one(f"{t}|{k}") for k in KIND_NAMES]) for t in ("own", "before", "before2", "after", "after2")}
        self.plain_shape = np.array([one(f"shape|{k}") for k in KIND_NAMES])
        self.shape = np.array([[one(f"shape|{k}|{z}") for z in range(SIZES)] for k in KIND_NAMES])
        self.turns = np.array([[one(f"turns|{k}|{u}") for u in range(TURNS)] for k in KIND_NAMES])
        self.key = np.array([[one(f"key|{x}|{k}") for k in KIND_NAMES] for x in (False, True)])
        self.file = np.array([[one(f"file|{x}|{k}") for k in KIND_NAMES] for x in range(FILES)])

    def plain_lead(self) -> float:
        """The lead of outside over begin and inside at a plain token among plain ones."""
        flat = self.weights.get(FLAT, np.zeros(LABELS))
        return float(flat[OUTSIDE] - max(flat[BEGIN], flat[INSIDE]))

    def emissions(self, tokens: list[str], runs: list[tuple[int, int]], file: int) -> list[np.ndarray]:
        """For each run of tokens, the score of each token's tags: the sum of ``features``' weights."""
        out = []
        edge = (0, 0, 0, True)
        for start, end in runs:
            shapes = [shape_of(tokens[i]) if 0 <= i < len(tokens) else edge for i in range(start - REACH, end + REACH)]
            kind, size, turns, plain = (np.array(x) for x in zip(*shapes))
            n = end - start
            own, size, turns, mine = (x[REACH : REACH + n] for x in (kind, size, turns, plain))
            at = lambda k: kind[REACH + k : REACH + k + n]
            quiet = np.ones(n, bool)
            for k in range(-REACH, REACH + 1):
                quiet &= plain[REACH + k : REACH + k + n]
            key = ((at(-1) == _KIND_AT["key"]) | (at(-2) == _KIND_AT["key"])).astype(int)
            score = self.near["own"][own] + np.where(mine[:, None], self.plain_shape[own], self.shape[own, size]) + self.turns[own, turns]
            for k, name in ((-1, "before"), (-2, "before2"), (1, "after"), (2, "after2")):
                score += self.near[name][at(k)]
            score += self.key[key, own] + self.file[file, own]
            out.append(np.where(quiet[:, None], self.flat, score))
        return out

    def viterbi(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each run, all runs together, a token a step."""
        order = sorted(range(len(emits)), key=lambda i: -len(emits[i]))
        lengths = np.array([len(emits[i]) for i in order])
        first = np.cumsum(lengths) - lengths
        flat = np.concatenate([emits[i] for i in order])
        best, back = self.moves[OUTSIDE] + flat[first], []
        for t in range(1, int(lengths[0])):
            open_ = int(np.searchsorted(-lengths, -t))  # runs with a token t
            way = best[:open_, :, None] + self.moves
            back.append(way.argmax(axis=1).astype(np.int8))
            best = np.concatenate((way.max(axis=1) + flat[first[:open_] + t], best[open_:]))
        tags = np.zeros(len(flat), np.int8)
        now = (best + self.moves[:, OUTSIDE]).argmax(axis=1)
        tags[first + lengths - 1] = now
        for t in range(int(lengths[0]) - 1, 0, -1):
            step = back[t - 1]
            now[: len(step)] = step[np.arange(len(step)), now[: len(step)]]
            tags[first[: len(step)] + t - 1] = now[: len(step)]
        out: list[np.ndarray] = [tags] * len(emits)
        for i, a, n in zip(order, first, lengths):
            out[i] = tags[a : a + n]
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Of each text, (start, end) of what is tagged begin or inside."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        sought, emits = [], []
        for row, text in enumerate(texts):
            tokens = TOKEN.findall(text)
            runs = windows(tokens) if self.prunes else [(0, len(tokens))] if tokens else []
            if runs:
                sought += [(row, start) for start, _ in runs]
                emits += self.emissions(tokens, runs, file_features(tokens))
        if not emits:
            return found
        tagged: dict[int, dict[int, int]] = {}
        for (row, start), tags in zip(sought, self.viterbi(emits)):
            for i in np.flatnonzero(tags != OUTSIDE).tolist():
                tagged.setdefault(row, {})[start + i] = int(tags[i])
        for row, tags in tagged.items():
            places = [m.span() for m in TOKEN.finditer(texts[row])]
            own: list[list[int]] = []
            for i in sorted(tags):
                if tags[i] == INSIDE and own and i - 1 in tags:
                    own[-1][1] = places[i][1]
                else:
                    own.append(list(places[i]))
            found[row] = [(a, b) for a, b in own]
        return found


def windows(tokens: list[str]) -> list[tuple[int, int]]:
    """Runs of tokens within REACH of one that isn't plain; neighbouring runs are one."""
    runs: list[list[int]] = []
    for i in [i for i, t in enumerate(tokens) if not is_plain(t)]:
        start, end = max(0, i - REACH), min(len(tokens), i + REACH + 1)
        if runs and start <= runs[-1][1]:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    return [(a, b) for a, b in runs]


def labelled_windows(text: str, raw: bytes) -> list[tuple[list[str], list[int], int]]:
    """(tokens, tags, file) of the windows of a text, with some plain words around, cut into
    parts of WINDOW tokens; tags from the base spans."""
    tokens = TOKEN.findall(text)
    runs = windows(tokens)
    if not runs:
        return []
    places = [m.span() for m in TOKEN.finditer(text)]
    tags = [OUTSIDE] * len(tokens)
    starts = np.array([p[0] for p in places])
    for start, end, kind in base_spans(text, raw):
        if kind == "assign":  # the value alone is the secret
            start = ASSIGN.match(text, start).start(2)
        first = int(np.searchsorted(starts, start, "right") - 1)
        last = int(np.searchsorted(starts, end, "left"))
        if tags[first] == OUTSIDE:
            tags[first:last] = [BEGIN] + [INSIDE] * (last - first - 1)
    file = file_features(tokens)
    out = []
    for start, end in runs:
        start, end = max(0, start - REACH), min(len(tokens), end + REACH)
        for at in range(start, end, WINDOW):
            stop = min(end, at + WINDOW)
            out.append(([t[:TOKEN_CHARS] for t in tokens[at:stop]], tags[at:stop], file))
    return out


def fit(samples: list[tuple[list[str], list[int], int]]) -> Field:
    """Maximum likelihood with a ridge, by Adam; windows are padded and worked on together."""
    names: dict[str, int] = {}
    longest = max(len(s[0]) for s in samples)
    ids = np.zeros((len(samples), longest, TEMPLATES), np.int64)
    tags = np.full((len(samples), longest), OUTSIDE)
    there = np.zeros((len(samples), longest), bool)
    names["|none"] = 0
    for i, (tokens, marks, file) in enumerate(samples):
        if i % 2 and any(m != OUTSIDE for m in marks):  # hide the sign and quotes before the secret
            kept = [j for j, t in enumerate(tokens) if not (t in "=:\"'" and marks[j] == OUTSIDE)]
            tokens, marks = [tokens[j] for j in kept], [marks[j] for j in kept]
        for j in range(len(tokens)):
            own = [names.setdefault(f, len(names)) for f in features(tokens, j, file)]
            ids[i, j, : len(own)] = own
        tags[i, : len(tokens)], there[i, : len(tokens)] = marks, True
    n = len(names)
    weights, moves = np.zeros((n, LABELS)), np.zeros((LABELS, LABELS))
    rows, cols = np.nonzero(there)
    flat = ids[rows, cols]
    seen = np.zeros((n, LABELS))
    np.add.at(seen, (flat.ravel(), np.repeat(tags[rows, cols], TEMPLATES)), 1)
    before = np.concatenate((np.full((len(samples), 1), OUTSIDE), tags), axis=1)
    steps = np.zeros((LABELS, LABELS))
    np.add.at(steps, (before[:, :-1][there], tags[there]), 1)
    lengths = there.sum(axis=1)
    last = tags[np.arange(len(samples)), lengths - 1]
    np.add.at(steps, (last, np.full(len(last), OUTSIDE)), 1)
    m1 = [np.zeros_like(weights), np.zeros_like(moves)]
    m2 = [np.zeros_like(weights), np.zeros_like(moves)]
    scale = 1.0 / len(samples)
    for step in range(1, ROUNDS + 1):
        weights[0] = 0
        emit = weights[ids].sum(axis=2)
        emit_there = np.where(there[:, :, None], emit, 0.0)
        expected, expected_steps = marginals(emit_there, moves, there)
        model = np.zeros((n, LABELS))
        for label in range(LABELS):
            model[:, label] = np.bincount(flat.ravel(), np.repeat(expected[rows, cols, label], TEMPLATES), n)
        slopes = [(seen - model) * scale - 1e-4 * weights, (steps - expected_steps) * scale - 1e-4 * moves]
        for k, (w, g) in enumerate(zip((weights, moves), slopes)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w += 0.15 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Field({name: weights[i] for name, i in names.items() if i}, moves)


def marginals(emit: np.ndarray, moves: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected tags of each place and expected transitions, by the forward-backward sums."""
    n, length, _ = emit.shape

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    ahead = np.zeros((n, length, LABELS))
    ahead[:, 0] = moves[OUTSIDE] + emit[:, 0]
    for t in range(1, length):
        step = total(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t]
        ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
    whole = total(ahead[:, -1] + moves[:, OUTSIDE], 1)
    behind = np.zeros((n, length, LABELS))
    behind[:, -1] = moves[:, OUTSIDE]
    pairs = np.zeros((LABELS, LABELS))
    for t in range(length - 1, 0, -1):
        on = there[:, t]
        reach = moves + (emit[:, t] + behind[:, t])[:, None, :]
        both = np.exp(ahead[:, t - 1, :, None] + reach - whole[:, None, None])
        pairs += both[on].sum(axis=0)
        behind[:, t - 1] = np.where(on[:, None], total(reach, 2), behind[:, t])
    tags = np.exp(ahead + behind - whole[:, None, None])
    pairs[OUTSIDE] += tags[:, 0].sum(axis=0)
    pairs[:, OUTSIDE] += tags[np.arange(n), there.sum(axis=1) - 1].sum(axis=0)
    return tags, pairs


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Field | None:
    """The field of a bounded sample of windows; None if no document shows a secret."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    n = rows.count()
    share = min(1 << 40, (1 << 40) * SAMPLE_DOCS // max(1, n))
    rows = rows.withColumn("sampled", F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < share)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"id": [], "tokens": [], "tags": [], "file": [], "secret": []}
        for doc, raw, sampled in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
            text = raw.decode()
            if sampled or base_spans(text, raw):
                for tokens, tags, file in labelled_windows(text, raw):
                    secret = any(t != OUTSIDE for t in tags)
                    if secret or sampled:
                        for name, value in zip(out, (doc, tokens, tags, file, secret)):
                            out[name].append(value)
        return out

    found = settle(map_batches(rows, "id bigint, tokens array<string>, tags array<int>, file int, secret boolean", run), "windows")
    order = (F.xxhash64("id"), F.col("id"), F.xxhash64("tokens"), F.col("tags"))
    half = TRAIN_WINDOWS // 2
    picked = [found.filter(c).orderBy(*order).limit(half).select("tokens", "tags", "file").collect() for c in (F.col("secret"), ~F.col("secret"))]
    samples = [(list(r.tokens), list(r.tags), r.file) for part in picked for r in part]
    return fit(samples) if picked[0] else None


def secret_scan(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): arrays of (start, stop, kind), by start."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    span = "array<struct<start:int,stop:int,kind:string>>"

    def run(batch: pa.RecordBatch) -> dict:
        base, added = [], []
        raws = text_bytes(batch.column(1))
        texts = [raw.decode() for raw in raws]
        tagged = shared.value.spans_of(texts) if shared.value else [[]] * len(texts)
        for text, raw, more in zip(texts, raws, tagged):
            fixed = base_spans(text, raw)
            more = [(a, b, "field") for a, b in more if not any(a < e and s < b for s, e, _ in fixed)]
            for out, spans in ((base, fixed), (added, more)):
                out.append([{"start": a, "stop": b, "kind": k} for a, b, k in spans])
        return {key: batch.column(0), "base": base, "added": added}

    return map_batches(docs.select(F.col(key).cast("long").alias(key), text), f"{key} bigint, base {span}, added {span}", run)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Contract of op4."""
    found = secret_scan(docs, train(docs))
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    place = {k: i for i, k in enumerate((*KINDS, "field"))}
    order = F.create_map(*[F.lit(x) for pair in place.items() for x in pair])
    ranked = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("place"), s.stop.alias("stop"), s.kind.alias("kind"))))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(ranked).alias("spans"),
    )
