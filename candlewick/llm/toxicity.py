"""Toxic spans and scores by a linear-chain conditional random field.

The field tags each word of a text clean or toxic, from features of the word (itself, its beginnings and
ends) and of the tag before it. Forward-backward gives each word's marginal probability; a document's
score comes from the odds of its words, its spans are runs of words whose marginal is one half or more.

Only documents are labelled, so the words of the training sample are labelled first: a word's evidence is
that of its strongest feature, by how many toxic and how many clean documents of the sample have it, and
in each toxic document the words whose evidence comes near the strongest one's are its toxic words. The
field is fitted to these by maximum likelihood, on words in their context.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, held, plainly_named, text_pieces

#: Documents of each label in the training sample, at most; and the bytes of one such document, at most.
SAMPLE = 1_500
SAMPLE_BYTES = 24_000
#: A toxic document's words count as toxic if their evidence is at least this part of the document's strongest.
NEAR = 0.35
CONTEXT = 6
THRESHOLD = 0.3
#: Bytes of words whose potentials a worker keeps, about.
CACHE = 50_000_000

_INNER = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The feature names of a word (what stands between white space): of its letters and digits, lower-cased."""
    out = []
    low = word.lower()
    for core in (low,) if low.isalnum() else _INNER.findall(low):
        n = len(core)
        out.append("w" + core)
        if n > 3:
            out += ("p" + core[:3], "s" + core[-3:])
            if n > 4:
                out += ("p" + core[:4], "s" + core[-4:])
                if n > 5:
                    out.append("p" + core[:5])
                    if n > 6:
                        out.append("p" + core[:6])
    return out


def label_words(texts: list[str], toxic: list[int]) -> list[set[str]]:
    """For each text the words that are labelled toxic; none for texts that are not."""
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    if not n1:
        return [set() for _ in texts]
    seen: list[dict[str, int]] = [{}, {}]
    # Features that stand for a word: the word and beginnings of 4 letters or more.
    strong = lambda w: [f for f in features(w) if f[0] == "w" or f[0] == "p" and len(f) > 4]
    vocabularies = [set(t.split()) for t in texts]
    known = {w: strong(w) for v in vocabularies for w in v}
    for v, y in zip(vocabularies, toxic, strict=True):
        own = seen[1 if y else 0]
        for f in {f for w in v for f in known[w]}:
            own[f] = own.get(f, 0) + 1

    def evidence(f: str) -> float:
        a, b = seen[1].get(f, 0), seen[0].get(f, 0)
        odds = math.log(a / n1) - math.log((b + 0.5) / (n0 + 1))
        return a * odds if odds > math.log(6) else 0.0

    out = []
    for v, y in zip(vocabularies, toxic, strict=True):
        if not y:
            out.append(set())
            continue
        weight = {w: max((evidence(f) for f in known[w]), default=0.0) for w in v}
        least = max(NEAR * max(weight.values(), default=0.0), 6.0)
        out.append({w for w, x in weight.items() if x >= least})
    return out


@dataclass
class Field:
    """A fitted field. weights: by feature name, for the toxic tag (none: 0); bias; turn[a][b]: for tag b after tag a; start: for the first tag; scale, shift: of the document score."""

    weights: dict[str, float]
    bias: float = -9.0
    turn: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    scale: float = 1.0
    shift: float = 0.0
    fitted: bool = True

    def potential(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) for f in features(word)])


def _passes(field_: Field, u: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratios of the two tags at each word, given what stands up to it, and given what follows it.

    Texts lie end to end (text i: bounds[i] to bounds[i+1]) and advance together, longest first, one word a step.
    """
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    first, size = bounds[:-1][order], size[order]
    ahead, back, t = np.zeros(len(u)), np.zeros(len(u)), field_.turn
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), side="left").tolist()  # texts of more than k words
    # In odds: after r, the next word's are (e01 + e11 r) / (e00 + e10 r) times its own.
    e00, e01, e10, e11 = np.exp(t).ravel().tolist()
    own = np.exp(np.clip(u, -60, 60))
    if longest:
        at = first[: live[0]]
        r = own[at] * np.exp(field_.start[1] - field_.start[0])
        ahead[at] = r
        for n in live[1:]:
            at, r = at[:n] + 1, r[:n]
            r = own[at] * (e01 + e11 * r) / (e00 + e10 * r)
            ahead[at] = r
        at = first + size - 1
        back[at[size > 0]] = 1.0
        at, r = at[: live[0]], np.ones(live[0])
        for n in live[1:]:
            at = at[:n]
            r = own[at] * r[:n]
            r = (e10 + e11 * r) / (e00 + e01 * r)
            at = at - 1
            back[at] = r
    return np.log(np.maximum(ahead, 1e-300)), np.log(np.maximum(back, 1e-300))


def marginals(field_: Field, u: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each word's log odds of being toxic, by forward-backward."""
    ahead, back = _passes(field_, u, bounds)
    return ahead + back


def fit(texts: list[str], toxic: list[int], rounds: int = 80, rate: float = 0.35, penalty: float = 2e-4, seed: int = 5) -> Field:
    """Maximum likelihood by Adam on windows: the context of each toxic word, and as many and more words of clean text."""
    words = label_words(texts, toxic)
    rng = np.random.default_rng(seed)
    windows: list[list[str]] = []
    tags: list[list[int]] = []
    starts: set[str] = {w.lower()[:3] for x in words for w in x}
    clean_words: set[str] = set()
    for text, own, y in zip(texts, words, toxic, strict=True):
        tokens = text.split()
        if not tokens:
            continue
        if own:
            hits = [i for i, w in enumerate(tokens) if w in own]
            for i in (hits if len(hits) <= 5 else sorted(rng.choice(hits, 5, replace=False).tolist())):
                part = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
                windows.append(part)
                tags.append([int(w in own) for w in part])
        elif not y:
            for i in rng.integers(0, len(tokens), 4).tolist():
                part = tokens[max(0, i - CONTEXT) : i + CONTEXT + 1]
                windows.append(part)
                tags.append([0] * len(part))
            clean_words |= {w for w in tokens if w.lower()[:3] in starts}
    model = Field({})
    if not any(1 in t for t in tags):
        model.fitted = False
        return model
    # Clean words that begin like a toxic one are the hard cases: each is seen in a window of its own.
    hard = sorted(clean_words)
    for i in range(0, len(hard), 8):
        windows.append(hard[i : i + 8])
        tags.append([0] * len(hard[i : i + 8]))
    names = sorted({w for x in windows for w in x})
    number = {w: i for i, w in enumerate(names)}
    used: dict[str, int] = {}
    listed = [[used.setdefault(f, len(used)) for f in features(w)] for w in names]
    flat, of = np.array([f for x in listed for f in x], np.int64), np.repeat(np.arange(len(names)), [len(x) for x in listed])
    token = np.array([number[w] for x in windows for w in x])
    y = np.array([t for x in tags for t in x])
    size = np.array([len(x) for x in windows])
    bounds = np.concatenate([[0], np.cumsum(size)])
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    pos = np.flatnonzero(inner)
    seen = np.array([[np.sum((y[pos - 1] == a) & (y[pos] == b)) for b in (0, 1)] for a in (0, 1)], float)
    first = np.bincount(y[bounds[:-1]], minlength=2).astype(float)
    seen_words = np.bincount(token, y, len(names))
    x = np.zeros(len(used) + 7)
    x[len(used)] = -4.0
    m, v, n = np.zeros_like(x), np.zeros_like(x), len(y)
    for step in range(1, rounds + 1):
        w, model.bias = x[: len(used)], float(x[len(used)])
        model.turn, model.start = x[len(used) + 1 : len(used) + 5].reshape(2, 2), x[len(used) + 5 :]
        u = (np.bincount(of, w[flat], len(names)) + model.bias)[token]
        ahead, back = _passes(model, u, bounds)
        p = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
        pairs = _pairs(model, ahead, back + u, pos)
        by_word = seen_words - np.bincount(token, p, len(names))
        start = np.array([np.sum(1 - p[bounds[:-1]]), np.sum(p[bounds[:-1]])])
        gradient = np.concatenate([np.bincount(flat, by_word[of], len(used)), [by_word.sum()], (seen - pairs).ravel(), first - start]) / n - penalty * np.concatenate([w / 10, np.zeros(1), x[len(used) + 1 :]])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient * gradient
        x = x + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights = {f: float(w) for f, w in zip(used, x, strict=False) if abs(w) > 1e-4}
    model.bias, model.turn, model.start = float(x[len(used)]), x[len(used) + 1 : len(used) + 5].reshape(2, 2).copy(), x[len(used) + 5 :].copy()
    _calibrate(model, texts, toxic)
    return model


def _pairs(model: Field, ahead: np.ndarray, back: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The expected number of each pair of tags at neighbouring words. back: with the word's own potential."""
    t = model.turn
    a, b = ahead[pos - 1], back[pos]
    logs = np.stack([np.full(len(pos), t[0, 0]), t[0, 1] + b, t[1, 0] + a, t[1, 1] + a + b])
    logs -= logs.max(0)
    p = np.exp(logs)
    return (p / p.sum(0)).sum(1).reshape(2, 2)


def evidence_of(odds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each text the logarithm of the 4-norm of its words' odds, from -30 (no words) to 30: the input of its score.

    One word of high odds suffices, several add to it, and thousands of clean words don't add up.
    """
    total = np.exp(4 * np.clip(odds, -30, 30))
    full = bounds[1:] > bounds[:-1]
    out = np.full(len(full), -30.0)
    if full.any():
        out[full] = np.log(np.maximum(np.add.reduceat(total, bounds[:-1][full]), 1e-52)) / 4
    return np.clip(out, -30, 30)


def _laid_out(field_: Field, texts: list[str], cache: dict[str, float]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    tokens = [t.split() for t in texts]
    if cache.get("", 0) > CACHE:  # no word is empty: there stand the bytes held, about
        cache.clear()
    fresh = {w for x in tokens for w in x}.difference(cache)
    cache[""] = cache.get("", 0) + 150 * len(fresh) + 2 * sum(map(len, fresh))
    for w in fresh:
        cache[w] = field_.potential(w)
    get = cache.__getitem__
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int64)
    u = np.fromiter((v for x in tokens for v in map(get, x)), float, int(bounds[-1]))
    return u, bounds, tokens


def _calibrate(model: Field, texts: list[str], toxic: list[int], rounds: int = 400) -> None:
    """A logistic map from evidence to score, fitted to the sample with both labels weighing the same."""
    u, bounds, _ = _laid_out(model, texts, {})
    z, y = evidence_of(marginals(model, u, bounds), bounds), np.array(toxic, float)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    a, b = 0.5, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        g = weight * (y - p)
        h = weight * p * (1 - p) + 1e-9
        hessian = np.array([[np.sum(h * z * z) + 1e-5, np.sum(h * z)], [np.sum(h * z), np.sum(h) + 1e-5]])
        da, db = np.linalg.solve(hessian, [np.sum(g * z) - 1e-5 * a, np.sum(g) - 1e-5 * b])
        a, b = a + float(np.clip(da, -1, 1)), b + float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-9:
            break
    model.scale, model.shift = max(a, 1e-3), b


class Scorer:
    def __init__(self, model: Field):
        self.model, self.cache = model, {}

    def scores(self, texts: list[str], spans: bool = False, least: float = 0.5):
        """(score, spans) of each text; spans: (start, end, probability) of runs of toxic words, in code points, ends exclusive."""
        if not self.model.fitted:
            return [(0.0, []) for _ in texts]
        u, bounds, tokens = _laid_out(self.model, texts, self.cache)
        odds = marginals(self.model, u, bounds)
        z = evidence_of(odds, bounds)
        score = 1 / (1 + np.exp(-np.clip(self.model.scale * z + self.model.shift, -60, 60)))
        found: list[list] = [[] for _ in texts]
        if spans:
            cut = math.log(least / (1 - least))
            which = np.unique(np.searchsorted(bounds, np.flatnonzero(odds >= cut), side="right") - 1)
            for i in which.tolist():
                found[i] = _runs(texts[i], odds[bounds[i] : bounds[i + 1]], cut)
        return list(zip(score.tolist(), found, strict=True))


def _runs(text: str, odds: np.ndarray, cut: float) -> list[tuple[int, int, float]]:
    out, at, held = [], 0, False
    for word, x in zip(text.split(), odds.tolist(), strict=True):
        start = text.index(word, at)
        at = start + len(word)
        p = 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))
        if x < cut:
            held = False
        elif held:
            out[-1] = (out[-1][0], at, max(out[-1][2], p))
        else:
            out.append((start, at, p))
            held = True
    return out


def held_out(id_col):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Field:
    """Fits the field on a bounded sample: of each label the documents whose ids' hashes are smallest, without held-out ones.

    Labels that are null, and labels without a document, are left out; of several labels of one id the
    greatest counts. Documents of more than SAMPLE_BYTES and null texts are no training examples (they are
    scored like all others); repeated rows of an id are one example. With no toxic example, as from empty
    tables, the field says 0 for every text. Columns besides the named ones are not read.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    order = F.xxhash64(F.col("__id").cast("string"), F.lit(11))
    chosen = [rows.where(F.col("__y") == y).orderBy(order, "__id").limit(sample) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionAll(chosen[1]))  # 2 * sample rows at most
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where(F.octet_length("__text") <= SAMPLE_BYTES)
    found = texts.join(ids, "__id").groupBy("__id", "__y").agg(F.min("__text").alias("__text")).toPandas()
    found = found.sort_values("__id")
    return fit(found["__text"].tolist(), found["__y"].astype(int).tolist()) if len(found) else Field({}, fitted=False)


def score(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(id, score, spans array<struct<start, end, probability>>) for each row of docs.

    Null and empty texts have the score of no evidence and no spans; repeated rows give repeated results; an
    empty table gives an empty result; other columns, whatever their names, are not read. No shuffle: a row's
    result depends on that row only.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches):
        own = held("toxicity", id(shared.value), lambda: Scorer(shared.value))
        for b in text_pieces(batches):
            got = own.scores([t or "" for t in b.column(1).to_pylist()], spans)
            found = pa.array([[{"start": s, "end": e, "probability": p} for s, e, p in x] for _, x in got], pa.list_(span))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.float64()), found], names=[id_col, "score", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).transform(arrow, run, f"`{id_col}` {kind}, score double, spans array<struct<start:long,end:long,probability:double>>")


def offsets(spans: str):
    """Spans as text: start:end of each, comma-joined; code points, ends exclusive."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))))


def keep_clean(docs: DataFrame, model: Field, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns, whatever their names and types.

    Null and empty texts stay; of repeated rows all stay or all go; an empty table gives an empty result.
    """
    import pyarrow as pa

    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        own = held("toxicity", id(shared.value), lambda: Scorer(shared.value))
        for b in text_pieces(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            keep = [x < threshold or not t for t, (x, _) in zip(texts, own.scores(texts), strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    rows, _ = plainly_named(docs)
    return rows.transform(arrow, run, rows.schema).toDF(*docs.columns)
