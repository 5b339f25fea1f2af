"""Jaccard join of word n-grams with adaptive multi-match prefixes.

Each document is the set of its distinct n-word shingles. All sets are ordered alike: by how often a
shingle is estimated to occur, rarest first. Two sets that overlap enough share at least l shingles in the
first |x| - ceil(t |x|) + l of each, for every l (the l-prefix). Each document takes the l that minimises its
estimated cost: a longer prefix is dearer to index but lets l shared shingles be required of a candidate.

Exact duplicates are one node from the start. Each node has a histogram of its shingles' hashes; the sum of
the smaller counts is an upper bound of two nodes' overlap, and pairs that it rules out are dropped at once.
A shingle that few nodes hold gives its other pairs, and a pair becomes a candidate if it shares the smaller
of the two l. A shingle that many nodes hold gives a forest that connects those pairs, and one that very
many hold ties them all to itself. Connected nodes form candidate groups of some near copies each, whose
whole sets are then compared: each group in one task, groups that are too large in blocks. Pairs that are
already connected need no comparison, so a group of m near copies costs far less than m^2.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import BROADCAST_ROWS, arrow, bloom, forget, held, plainly_named, stage, tasks, text_pieces
from .graph import components

#: Counters of estimated shingle frequencies; the estimates only order shingles and choose l, so results don't depend on them.
SKETCH = 1 << 20
CHUNKS = 64
#: The greatest l.
LEVELS = 3
#: A shingle held by more nodes than this gives a forest instead of pairs, and by more than MANY one tree of all of them.
PAIRS_OF = 12
MANY = 4_096
#: A shingle estimated to occur so often is dealt out by node as well, and all its holders are tied to it.
HOT = 1_000_000
#: Bins of the histograms: those of sets of up to so many shingles, and of larger ones; and the size from which a set's
#: histogram says nothing, as counts end at 255.
BINS = ((256, 64), (1_024, 128), (LONG := 20_000, 256))
#: Estimated cost of a candidate, in prefix shingles.
VERIFY = 16.0
#: A candidate group of more shingles than this is compared in blocks of so many nodes.
GROUP = 2_000_000
BLOCK = 512
LEADERS = 64

_M64 = (1 << 64) - 1
_MULT = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


class _Words(dict):
    """64-bit hashes of words, kept up to about a bound in bytes."""

    limit, held = 60_000_000, 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if self.held > self.limit:
            self.clear()
            self.held = 0
        self.held += 180 + len(word)
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, n: int, known: dict | None = None) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes.

    Words: what stands between space, tab, newline, vertical tab, form feed and carriage return, with A-Z
    lower-cased. Fewer than n words are one shingle; no words, none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = held("jaccard", None, _Words) if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < n:
        short = 0x243F6A8885A308D3 + len(h)
        for x in h.tolist():
            short = ((short ^ x) * 0x9E3779B97F4A7C15 + 0x1234567) & _M64
            short ^= short >> 31
        return np.array([short], np.uint64)
    size = len(h) - n + 1
    k = np.zeros(size, np.uint64)
    for i in range(n):
        k += h[i : i + size] * np.uint64(_MULT[i % 8] + 2 * (i // 8))
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    k ^= k >> np.uint64(32)
    return np.unique(k)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a hash of a whole set; one set, one key."""
    k = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
    return int(k[0]), int(k[1])


def histogram(s: np.ndarray) -> bytes:
    """How many of a set's shingles fall in each bin by the first bits of their hashes, up to 255."""
    most = next((b for size, b in BINS if len(s) <= size), BINS[-1][1])
    return np.minimum(np.bincount((s >> np.uint64(65 - most.bit_length())).astype(np.int64), minlength=most), 255).astype(np.uint8).tobytes()


class Histograms:
    """The histograms of one shingle's nodes; those of unequal bins are compared with the finer one's bins added up."""

    def __init__(self, raw: list[bytes]):
        self.bins = np.array([len(x) for x in raw])
        self.at: dict[int, np.ndarray] = {}
        for least in np.unique(self.bins).tolist():
            own = self.at[least] = np.zeros((len(raw), least), np.int16)
            for k in np.flatnonzero(self.bins >= least):
                own[k] = np.frombuffer(raw[k], np.uint8).reshape(least, -1).sum(1)

    def bound(self, i: int, others: np.ndarray) -> np.ndarray:
        """The most shingles that node i may share with each of the others."""
        out, level = np.zeros(len(others), np.int64), np.minimum(self.bins[i], self.bins[others])
        for b in np.unique(level).tolist():
            some = level == b
            out[some] = np.minimum(self.at[b][i], self.at[b][others[some]]).sum(1, dtype=np.int64)
        return out


def _need(n, num: int, den: int):
    """ceil(t n): the least overlap of a set of n shingles with any that it links to."""
    return -(-n * num // den)


def _fingerprints(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """For each document its id, number of shingles and key; and for each task, in rows of their own, its part of the frequency counters."""
    import pyarrow as pa

    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "n", "k1", "k2", "bins", "chunk", "counts"]

    def run(batches):
        counts, seen, id_type = np.zeros(SKETCH, np.int32), set(), None
        for b in text_pieces(batches):
            id_type, size, keys, bins, fresh = b.schema.field(0).type, [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, n)
                key = set_key(s)
                size.append(len(s))
                keys.append(key)
                bins.append(histogram(s))
                if key not in seen:
                    seen.add(key)
                    fresh.append((s & np.uint64(SKETCH - 1)).astype(np.int32))
            if fresh:
                slot, c = np.unique(np.concatenate(fresh), return_counts=True)
                counts[slot] += c.astype(np.int32)
            rows = len(size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(bins, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names=names)
        if id_type is not None:
            step = SKETCH // CHUNKS
            parts = [counts[i * step : (i + 1) * step].tobytes() for i in range(CHUNKS)]
            empty = [pa.nulls(CHUNKS, t) for t in (id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.select(id_col, text_col).transform(arrow, run, f"`{id_col}` {kind}, n int, k1 long, k2 long, bins binary, chunk int, counts binary")


def _sketch(marks: DataFrame) -> np.ndarray:
    """The frequency counters, added up by chunk on the executors; SKETCH numbers come to the driver, whatever the input."""
    import pyarrow as pa

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int32).astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        if sums:
            parts = [np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    parts = marks.where("chunk is not null").select("chunk", "counts").repartition(CHUNKS // 4, "chunk").transform(arrow, add, "chunk int, counts binary").collect()
    out = np.zeros(SKETCH, np.int64)
    step = SKETCH // CHUNKS
    for r in parts:
        out[r["chunk"] * step : (r["chunk"] + 1) * step] += np.frombuffer(r["counts"], np.int32)
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def prefix(s: np.ndarray, counts: np.ndarray, floor: float, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The l-prefix of a set: its shingles, the least l at which each belongs to it, and l."""
    n = len(s)
    need = _need(n, num, den)
    first = n - need + 1
    estimate = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    order = np.argsort(estimate, kind="stable")[: first + LEVELS - 1]
    others = np.maximum(estimate[order] - floor, 1.0) - 1.0
    held = np.cumsum(others + 1.0)
    best, level = None, 1
    for l in range(1, min(LEVELS, need) + 1):
        at = min(first + l - 1, n) - 1
        cost = held[at] + VERIFY * (held[at] - at - 1) / l
        if best is None or cost < best:
            best, level = cost, l
    size = min(first + level - 1, n)
    return s[order[:size]], np.maximum(1, np.arange(1, size + 1) - first + 1), level


def _prefixes(docs: DataFrame, n: int, num: int, den: int, counts: np.ndarray, text_col: str, many: int = HOT) -> DataFrame:
    """(token, node, meta, salt) for each shingle of each set's prefix; a task gives a set once, however often it has it.

    salt: 0 for all holders of a shingle, or above 0 for all of them if its estimated count reaches `many`.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(counts)
    floor = float(counts.astype(np.float64).mean())

    def run(batches):
        own, seen = shared.value, set()
        for b in text_pieces(batches):
            tokens, nodes, metas = [], [], []
            for text in b.column(0).to_pylist():
                s = shingles(text, n)
                if not len(s):
                    continue
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                p, at, level = prefix(s, own, floor, num, den)
                tokens.append(p)
                nodes.append(np.full(len(p), key[0], np.int64))
                metas.append((len(s) << 16) + (level << 8) + at)
            if tokens:
                t = np.concatenate(tokens)
                # A shingle that may have millions of holders is dealt out by node as well.
                hot = own[(t & np.uint64(len(own) - 1)).astype(np.int64)] // many
                node = np.concatenate(nodes)
                salt = np.where(hot > 0, 1 + (node & 0xFFFF) % (hot + 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(node), pa.array(np.concatenate(metas).astype(np.int64)), pa.array(salt.astype(np.int32))], names=["token", "node", "meta", "salt"])

    return docs.select(text_col).transform(arrow, run, "token long, node long, meta long, salt int")


def alike_in_size(run: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which rows have another of their run that they may link with by size: the next smaller or the next larger one."""
    order = np.lexsort((size, run))
    r, s = run[order], size[order]
    near = (r[1:] == r[:-1]) & (den * s[:-1] >= num * s[1:])
    out = np.zeros(len(run), bool)
    out[order] = np.r_[False, near] | np.r_[near, False]
    return out


def _shared(rows: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Of the prefixes' rows those whose shingle another node of a size that allows a link holds, each node once.

    A salted shingle's rows all go out, as do those of a shingle of more than MANY holders.
    """
    import pyarrow as pa

    names = ["token", "node", "meta", "salt"]

    def run(batches):
        held: list[np.ndarray] | None = None  # the last shingle's rows, as more may follow in the next batch
        sent = False  # whether other rows of that shingle went out already
        for b in batches:
            c = [b.column(i).to_numpy() for i in range(4)]
            if held is not None:
                c = [np.concatenate([x, y]) for x, y in zip(held, c, strict=True)]
            token, node, meta, salt = c
            first = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
            fresh = first | np.r_[True, node[1:] != node[:-1]]
            run_of = np.cumsum(first) - 1
            last = run_of == run_of[-1]
            give, at = fresh & ~last, np.flatnonzero(fresh & ~last & (salt == 0))
            give[at] = alike_in_size(run_of[at], meta[at] >> 16, num, den) | (run_of[at] == 0) & sent
            tail = np.flatnonzero(last & fresh)
            if len(tail) > MANY:  # enough to know: all but one row go out, and that one stays to be met by later ones
                give[tail[:-1]] = True
                tail = tail[-1:]
                sent = True
            else:
                sent = sent and not run_of[-1]
            held = [x[tail] for x in c]
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in c], names=names)
        if held is not None:
            # Of a shingle whose earlier rows went out already, one row is left.
            give = (held[3] > 0) | sent | alike_in_size(np.zeros(len(held[0]), int), held[2] >> 16, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in held], names=names)

    return rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "node").transform(arrow, run, "token long, node long, meta long, salt int")


def possible(sizes: np.ndarray, bins: Histograms, i: int, num: int, den: int, after: int) -> np.ndarray:
    """Of the nodes from `after` on those that node i may link with, by sizes and by the histograms' bound of the overlap."""
    n, other = int(sizes[i]), sizes[after:]
    fine = den * np.minimum(n, other) >= num * np.maximum(n, other)
    if n < LONG and fine.any():
        at = np.flatnonzero(fine)
        most = bins.bound(i, at + after)
        fine[at] = (den * most >= num * (n + other[at] - most)) | (other[at] >= LONG)
    return fine


def bucket_edges(nodes: np.ndarray, meta: np.ndarray, bins: Histograms, num: int, den: int, out: list) -> None:
    """Adds (a, b, need) for one shingle's nodes: pairs, or, if they are many, a forest with need 0."""
    sizes, levels, at, m = meta >> 16, meta >> 8 & 255, meta & 255, len(nodes)
    label = np.arange(m)
    for i in range(m - 1):
        if m > PAIRS_OF and (label[i + 1 :] == label[i]).all():
            continue
        need = np.minimum(levels[i], levels[i + 1 :])
        fine = possible(sizes, bins, i, num, den, i + 1) & (np.maximum(at[i], at[i + 1 :]) <= need)
        for j in np.flatnonzero(fine).tolist():
            if m <= PAIRS_OF:
                a, b = int(nodes[i]), int(nodes[i + 1 + j])
                out.append((min(a, b), max(a, b), int(need[j])))
            elif label[i + 1 + j] != label[i]:
                out.append((int(nodes[i]), int(nodes[i + 1 + j]), 0))
                label[label == label[i + 1 + j]] = label[i]


def _bucket_edges(rows: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """(a, b, need) of all shared shingles; rows: those of _shared, with each node's histogram."""
    import pyarrow as pa

    def flush(bucket, out):
        token, node, meta, salt, bins = bucket
        if len(node) > 1 and not salt[0]:
            node, one = np.unique(node, return_index=True)
            if len(node) > 1:
                bucket_edges(node, meta[one], Histograms([bins[k] for k in one]), num, den, out)

    def run(batches):
        held: list | None = None
        tied = None  # a shingle that very many hold
        for b in batches:
            c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            out: list[tuple[int, int, int]] = []
            token, node, salt = c[0], c[1], c[3]
            cut = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]).tolist()
            for s, e in zip(cut, [*cut[1:], len(token)], strict=True):
                mine = [x[s:e] for x in c]
                key = token[s], salt[s]
                if held is not None and (held[0][0], held[3][0]) == key:
                    held = [np.concatenate([x, y]) for x, y in zip(held, mine, strict=True)]
                else:
                    if held is not None:
                        flush(held, out)
                    held = mine
                if tied == key or salt[s] or len(held[0]) > MANY:
                    out += [(int(x), int(key[0]), 0) for x in np.unique(held[1])]
                    held, tied = None, key
            if out:
                yield _edges(pa, out)
        out = []
        if held is not None:
            flush(held, out)
        if out:
            yield _edges(pa, out)

    return rows.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt").transform(arrow, run, "a long, b long, need int")


def _edges(pa, out):
    a, b, need = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(need, pa.int32())], names=["a", "b", "need"])


def link_labels(sets: list[np.ndarray], num: int, den: int, leaders: int | None = None) -> np.ndarray:
    """For each set the position of one it is connected with by links, the same for all that are.

    A set is compared with all others at once, by counting its shingles' holders. Sets are taken until all
    that were not are connected with each other: each pair that isn't connected has then been compared.
    leaders: compare only the first so many with all.
    """
    m = len(sets)
    labels = np.arange(m)
    if m < 2:
        return labels
    size = np.array([len(s) for s in sets])
    if m == 2:
        x, y = sets
        both = len(np.intersect1d(x, y, assume_unique=True))
        if den * both >= num * (len(x) + len(y) - both):
            labels[1] = 0
        return labels
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, token, held = np.unique(flat, return_inverse=True, return_counts=True)
    by_token = np.argsort(token, kind="stable")
    holders, start = owner[by_token], np.concatenate([[0], np.cumsum(held)[:-1]])
    bounds = np.concatenate([[0], np.cumsum(size)])
    left = np.ones(m, bool)
    for step in range(m if leaders is None else min(leaders, m)):
        if leaders is not None:
            i = step
        else:
            most = np.argmax(np.bincount(labels[left], minlength=m))
            rest = np.flatnonzero(left & (labels != most))
            if not len(rest):
                break
            i = int(rest[0]) if step else 0
        mine = token[bounds[i] : bounds[i + 1]]
        mine = mine[held[mine] > 1]
        many = held[mine]
        left[i] = False
        if not len(mine):
            continue
        at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        both = np.bincount(holders[at], minlength=m)
        linked = den * both >= num * (size + size[i] - both)
        linked[i] = True
        joined = np.unique(labels[linked])
        labels[np.isin(labels, joined)] = joined[0]
    return labels


def _compared(rows: DataFrame, n: int | None, num: int, den: int, parts: int, leaders: bool = False) -> DataFrame:
    """(a, b) for each node a that links connect with a smaller one of its group: b is the smallest of those.

    rows: (gid, first, id, s); id is (rep, k1, k2), s the set, or, with n given, the text whose n-word shingles have the
    keys k1 and k2 (rows of other texts with that id are passed over). Groups stream through sorted partitions; one group
    is in memory at a time, each node once. leaders: only rows with first = 0 are compared with all the others.
    """
    import pyarrow as pa

    def flush(group, out):
        ids = sorted(group, key=lambda i: (group[i][0], i))
        labels = link_labels([group[i][1] for i in ids], num, den, sum(f == 0 for f, _ in group.values()) if leaders else None)
        least: dict[int, tuple] = {}
        for i, label in zip(ids, labels.tolist(), strict=True):
            least[label] = min(least.get(label, i), i)
        out += [(i, least[label]) for i, label in zip(ids, labels.tolist(), strict=True) if i != least[label]]

    def batch(out, kind):
        name = lambda i: dict(zip(("rep", "k1", "k2"), i, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([name(x[k]) for x in out], kind) for k in (0, 1)], names=["a", "b"])

    def run(batches):
        now, group, kind = None, {}, None
        for whole in batches:
            for b in text_pieces([whole]):
                out, kind = [], b.schema.field(2).type
                for g, f, i, s in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                    if g != now:
                        flush(group, out)
                        now, group = g, {}
                    i = i["rep"], i["k1"], i["k2"]
                    if i in group:
                        continue
                    if n is None:
                        group[i] = f, np.frombuffer(s, np.uint64)
                    else:
                        own = shingles(s, n)
                        if set_key(own) == i[1:]:
                            group[i] = f, own
                if out:
                    yield batch(out, kind)
        out = []
        flush(group, out)
        if out:
            yield batch(out, kind)

    named = dict(rows.dtypes)["id"]
    return rows.select("gid", "first", "id", "s").repartition(parts, "gid").sortWithinPartitions("gid").transform(arrow, run, f"a {named}, b {named}")


def _links_of_large(sets: DataFrame, sizes: DataFrame, num: int, den: int, block: int, parts: int) -> DataFrame:
    """(a, b) that connect what is linked within candidate groups too large for one task.

    First a bounded number of leaders of each group meets each block of it. Then only pairs of nodes of
    which one is outside the group's largest component are left: those nodes, in blocks, meet all blocks.
    """
    rows = sets.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "cluster").withColumn("blocks", F.ceil(F.col("nodes") / block).cast("int"))
    by_node = F.pmod(F.xxhash64("id"), F.col("blocks"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("id"), "id"))
    heads = rows.select("cluster", "id").withColumn("place", rank).where(F.col("place") <= LEADERS).select("id", F.lit(0).alias("head"))
    marked = rows.join(F.broadcast(heads) if heads.count() <= BROADCAST_ROWS else heads, "id", "left").withColumn("first", F.coalesce("head", F.lit(1)))
    gid = lambda *c: F.concat_ws("/", *[x.cast("string") for x in c])
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first_round = marked.where("first = 0").withColumn("at", every).unionByName(marked.where("first = 1").withColumn("at", by_node))
    found = stage(_compared(first_round.select(gid(F.col("cluster"), F.col("at")).alias("gid"), "first", "id", "s"), None, num, den, parts, leaders=True), "links")
    roots = components(found)
    labelled = rows.select("cluster", "id").join(roots, F.col("id") == F.col("node"), "left").select("cluster", "id", F.coalesce("root", "id").alias("root"))
    most = labelled.groupBy("cluster", "root").agg(F.count("*").alias("held")).groupBy("cluster").agg(F.max_by("root", F.struct("held", "root")).alias("main"))
    rest = labelled.join(most, "cluster").where("root <> main").select("cluster", "id")
    many = rest.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("rest_blocks"))
    outside = rows.join(many, "cluster").join(rest.select("id"), "id", "left_semi").withColumn("rb", F.pmod(F.xxhash64("id", F.lit(7)), F.col("rest_blocks")))
    left = outside.withColumn("at", every).select(gid(F.col("cluster"), F.col("rb"), F.col("at")).alias("gid"), F.lit(0).alias("first"), "id", "s")
    right = rows.join(many, "cluster").withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1))).select(gid(F.col("cluster"), F.col("rb"), by_node).alias("gid"), F.lit(1).alias("first"), "id", "s")
    more = stage(_compared(left.unionByName(right), None, num, den, parts, leaders=True), "links")
    return found.unionAll(more)


def _counted(texts: DataFrame, n: int, num: int, den: int, parts: int, group: int) -> DataFrame:
    """(k1, k2, links): for each node with links how many rows of other nodes it links to.

    texts: (cluster, held, id, rows, text). A cluster is dealt out in blocks of about half of `group` shingles, and each pair
    of blocks meets in one task: no link leaves it but as a sum.
    """
    import pyarrow as pa

    def probe(sets, of, sizes, rows, out, back):
        """Adds to out[i] the rows of `of` that sets[i] links to, and, if back is given, the other way round."""
        flat, owner = np.concatenate(of), np.repeat(np.arange(len(of)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for i, s in enumerate(sets):
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            many = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(of))
            linked = (both > 0) & (den * both >= num * (len(s) + sizes - both))
            if back is None:
                linked[i] = False
            else:
                back[linked] += rows[0][i]
            out[i] += rows[1][linked].sum()

    def flush(group_, out):
        sides = [[x for x in group_.values() if x[0] == f] for f in (0, 1)]
        counts = [np.zeros(len(x), np.int64) for x in sides]
        if not sides[0] or not sides[1] and sides[0][0][4]:  # nothing, or one block alone of a pair of blocks
            return
        sets, rows = [[x[3] for x in side] for side in sides], [np.array([x[2] for x in side], np.int64) for side in sides]
        if sides[1]:
            probe(sets[0], sets[1], np.array([len(s) for s in sets[1]]), rows, counts[0], counts[1])
        else:
            probe(sets[0], sets[0], np.array([len(s) for s in sets[0]]), [rows[0], rows[0]], counts[0], None)
        out += [(*x[1], int(c)) for side, own in zip(sides, counts, strict=True) for x, c in zip(side, own, strict=True) if c]

    def run(batches):
        now, group_ = None, {}
        for whole in batches:
            for b in text_pieces([whole]):
                out = []
                for g, first, across, i, m, text in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    if g != now:
                        flush(group_, out)
                        now, group_ = g, {}
                    key = i["rep"], i["k1"], i["k2"]
                    if key not in group_:
                        s = shingles(text, n)
                        if set_key(s) == key[1:]:
                            group_[key] = first, key[1:], m, s, across
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k1", "k2", "links"])
        out = []
        flush(group_, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k1", "k2", "links"])

    rows = texts.withColumn("blocks", F.ceil(2 * F.col("held") / group).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    gid = F.concat_ws("/", F.col("cluster").cast("string"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    rows = rows.select(gid.alias("gid"), (F.col("own") > F.col("other")).cast("int").alias("first"), (F.col("own") != F.col("other")).alias("across"), "id", "rows", "text")
    found = rows.repartition(parts, "gid").sortWithinPartitions("gid").transform(arrow, run, "k1 long, k2 long, links long")
    return found.groupBy("k1", "k2").agg(F.sum("links").alias("links"))


def _classes(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str, group: int, block: int, hot: int, links_too: bool = False) -> DataFrame:
    """(id, n, k1, k2, root[, n_links]) for each row of docs: its number of shingles, its set's key, and (rep, k1, k2) of the
    first node of its component, by rep, the smallest id of a node's rows; null without words."""
    import pyarrow as pa

    if not 0 < num <= den:
        raise ValueError("the threshold lies above 0 and at most at 1")
    parts = tasks(docs)
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marks = stage(_fingerprints(docs, n, "id", "text"), "keys")
    keys = marks.where("chunk is null").select("id", "n", "k1", "k2", "bins")
    nodes = keys.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("rows"))
    shared = _shared(_prefixes(docs, n, num, den, _sketch(marks), "text", hot), parts, num, den)
    bins = keys.where("n > 0").groupBy(F.col("k1").alias("node")).agg(F.min("bins").alias("bins"))
    edges = stage(_bucket_edges(shared.join(bins, "node").select("token", "node", "meta", "salt", "bins"), num, den, parts), "edges")
    pairs = edges.where("need > 0").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("need").alias("need")).where("shared >= need").select("a", "b")
    clusters = components(pairs.unionAll(edges.where("need = 0").select("a", "b")))
    forget(edges)
    # Shingles are nodes of the graph as well; only sets' keys are met here.
    wanted = stage(nodes.where("rep is not null").join(clusters, F.col("k1") == F.col("node")).select("rep", "k1", "k2", "n", "rows", F.col("root").alias("cluster")), "wanted")
    sizes = wanted.groupBy("cluster").agg(F.count("*").alias("nodes"), F.sum("n").alias("held")).where("nodes > 1").withColumn("large", F.col("held") > group)
    named = F.struct("rep", "k1", "k2").alias("id")
    picked = stage(wanted.join(sizes, "cluster").select("rep", "cluster", "large", "nodes", "held", "rows", named), "picked")
    forget(clusters, wanted)
    texts = docs.where(bloom(picked.select("rep"))(F.col("id"))).select(F.col("id").alias("rep"), "text").join(picked, "rep")
    fits = texts.where("not large").select(F.col("cluster").cast("string").alias("gid"), F.lit(0).alias("first"), "id", F.col("text").alias("s"))
    links = stage(_compared(fits, n, num, den, parts), "links")
    large = picked.where("large").groupBy("cluster").agg(F.max("nodes").alias("nodes"))
    if large.isEmpty():
        connected = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    else:

        def sets_of(batches):
            for b in text_pieces(batches):
                sets = [shingles(t, n) for t in b.column(2).to_pylist()]
                right = [set_key(s) == (i["k1"], i["k2"]) for s, i in zip(sets, b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "id", "s"]).filter(pa.array(right, pa.bool_()))

        kind = dict(picked.dtypes)["id"]
        sets = stage(texts.where("large").select("cluster", "id", "text").transform(arrow, sets_of, f"cluster long, id {kind}, s binary").dropDuplicates(["id"]), "sets")
        connected = components(links.unionAll(_links_of_large(sets, large, num, den, block, parts)))
    joined = nodes
    if links_too:
        counted = stage(_counted(texts, n, num, den, parts, group), "counted")
        joined = nodes.join(counted, ["k1", "k2"], "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("rows") - 1)
    more = ["n_links"] if links_too else []
    joined = joined.join(connected.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "root"), ["k1", "k2"], "left").select("k1", "k2", "rows", F.coalesce("root", F.struct("rep", "k1", "k2")).alias("root"), *more)
    # Sets that a thousandth of all rows or more have, a thousand at most, meet their rows where these are; the others by a shuffle.
    every = keys.select("id", "n", "k1", "k2")
    hot_sets = F.broadcast(stage(joined.where(F.col("rows") * 1_000 >= every.count()), "hot"))
    met = every.join(hot_sets, ["k1", "k2"]).unionByName(every.join(hot_sets, ["k1", "k2"], "left_anti").join(joined, ["k1", "k2"], "left"))
    return met.select("id", "n", "k1", "k2", F.when(F.col("n") > 0, F.col("root")).alias("root"), *more)


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, block: int = BLOCK, hot: int = HOT, links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id[, n_links]) for each row of docs.

    Two documents link when den * |intersection| >= num * |union| of their shingle sets (compared by 64-bit
    hashes); component_id is the smallest id reachable by links, the document's own included. A document
    without words has no shingles, links with nothing and is its own component. Documents of equal sets
    are one node; rows that repeat an id stay as many rows. A null id is never a component's smallest, and a
    set that only rows with null ids have is compared with nothing; its component is null. An empty table gives
    an empty result. Other columns, whatever their names, are not read. links: count for each row the other rows that
    it links with directly, too; this compares all pairs of unlike texts within each candidate group.

    docs is scanned three times, always whole: for keys and frequencies, for prefixes, and for the candidates'
    texts. Only texts that a Bloom filter of the candidates' ids lets through are shuffled, at any size.
    """
    found = _classes(docs, n, num, den, id_col, text_col, group, block, hot, links)
    more = [F.when(F.col("n") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")] if links else []
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("root.rep")).otherwise(F.col("id")).alias("component_id"), *more)


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: one of the smallest id, and of its rows of one set the first by hash.

    Documents without words all stay. A set that only rows without an id have is compared with nothing, and one of its rows
    stays. Rows of one id and unlike texts are judged each for itself. Empty tables give empty results; other
    columns, whatever their names and types, stay as they are.

    Rows that stay are never shuffled: a Bloom filter of the ids that go, or that several rows have, rules them out at
    the scan, and only the rest meet those ids in a join.
    """
    import pyarrow as pa

    columns = docs.columns
    rows, names = plainly_named(docs)
    id_, text = names[columns.index(id_col)], names[columns.index(text_col)]
    found = stage(_classes(docs, n, num, den, id_col, text_col, GROUP, BLOCK, HOT), "classes")
    stays = found.withColumn("stays", (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("root.rep")) & (F.col("k1") == F.col("root.k1")) & (F.col("k2") == F.col("root.k2"))))
    by_id = stays.where("id is not null").groupBy("id").agg(F.count("*").alias("rows"), F.bool_and("stays").alias("stays"))
    judged = stage(by_id.where("not stays or rows > 1").select("id", (F.col("rows") > 1).alias("several")), "judged")
    may_hold = F.coalesce(bloom(judged.select("id"))(F.col(id_)), F.lit(False))
    met = rows.where(may_hold).join(judged, F.col(id_) == F.col("id"), "left")
    kept = rows.where(~may_hold & F.col(id_).isNotNull()).unionAll(met.where("several is null").select(names))
    # Rows that share an id or have none: by the keys of their sets.
    several = met.where("several").select(names).unionAll(rows.where(F.col(id_).isNull()))
    at, schema = names.index(text), several.schema

    def keyed(batches):
        for b in text_pieces(batches):
            found = [set_key(s) if len(s) else (None, None) for s in (shingles(t, n) for t in b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k for k, _ in found], pa.int64()), pa.array([k for _, k in found], pa.int64())], names=[*names, "k1", "k2"])

    plain = [F.col(f.name) for f in schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    several = several.transform(arrow, keyed, StructType([*schema.fields, StructField("k1", LongType()), StructField("k2", LongType())]))
    first = F.row_number().over(Window.partitionBy(id_, "k1", "k2").orderBy(F.xxhash64(*plain)))
    chosen = several.where("k1 is not null").withColumn("place", first).where("place = 1")
    one = stays.where("stays and n > 0").select(F.col("id").alias("j"), F.col("k1").alias("j1"), F.col("k2").alias("j2")).distinct()
    chosen = chosen.join(one, F.col(id_).eqNullSafe(F.col("j")) & (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left_semi")
    return kept.unionAll(several.where("k1 is null").select(names)).unionAll(chosen.select(names)).toDF(*columns)
