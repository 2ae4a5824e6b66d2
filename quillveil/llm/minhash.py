"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, banded, then verified exactly.

A document is the multiset of its five-word shingles (words lower-cased, split at spaces and ASCII
punctuation; one to four words make one shingle). A shingle of weight w is discretised into the
intervals (0, 1], (1, 2], (2, 4], (4, 8] ...; each is a Poisson process whose rate is its width and
whose points carry a time, a level and a register. A point counts if its level is at most w, so two
documents share a shingle's points exactly as far as their weights agree, and a register's first
point is the same in both with probability the weighted Jaccard similarity, without bias. Points
come in order of time and a process stops once it is later than every register's first point.

Registers are banded (``BANDS`` bands of ``ROWS``; at similarity 0.8 a pair meets in no band with
probability 3e-6). Documents of equal words are one node first. In every bucket each node is compared
with the bucket's smallest and largest. In buckets that still hold more than one component, signatures
tell, in blocks, which nodes can have a partner in another one; their multisets are compared inside
the block, which gives out only links that join components, so links stay linear in the nodes. Every
link is verified on the multisets themselves (similarity >= 0.8). Classes are the components of the
links; the class id is the smallest id in it.

Null text and text without words is a class of its own, but rows that repeat with the same id and
text count as one document everywhere. Null ids come last in a class. An empty table gives an empty
result. Only the id and the text are read. Links and components stay distributed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, fresh, lean, materialize, ship

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: A pair whose signatures agree in less than this share is not verified: at similarity 0.8 and 160
#: registers this happens with probability below 1e-8.
LIKELY = 0.6
BLOCK = 1 << 18
MEMBERS, LEAD, ITEMS = 2048, 512, 500_000
SALTS = 64
#: Rows of the longest list that is broadcast, some 8 MB of ids and hashes; longer ones are joined by key.
SHORT = 200_000

_SPLIT = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling hash's base and of its inverse; those of a part of usual length are kept."""
    if n > 2 * BLOCK:
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, b)]), dtype=np.uint64) for b in (_P, _PINV))
    if not _POWERS:
        _POWERS.extend(_powers(2 * BLOCK + 1))
    return _POWERS[0][:n], _POWERS[1][:n]


_POWERS: list[np.ndarray] = []


def normalized(text: str | None) -> bytes:
    """The words, with one space between."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split())


def _parts(owner: int, norm: bytes) -> Iterator[tuple[int, bytes]]:
    """A text in parts of about BLOCK bytes; the next part begins with the last four words again.

    A part grows until it holds more than these four words, however long they are, so every part adds words.
    """
    at = 0
    while at < len(norm):
        end, back = at + BLOCK, -1
        while back < 0:
            end = norm.find(b" ", end) if end < len(norm) else -1
            if end < 0:
                yield owner, norm[at:]
                return
            back = end
            for _ in range(WORDS - 1):
                back = norm.rfind(b" ", at, back) if back >= 0 else -1
            end += back < 0
        yield owner, norm[at:end]
        at = back + 1


def shingles(norms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every shingle of every text, with repetitions, owners ascending."""
    hs, os_ = [], []
    group, size = [], 0

    def flush():
        buf = np.frombuffer(b"\n" + b"\n".join(p for _, p in group) + b"\n", dtype=np.uint8)
        up, down = _powers(len(buf) + 1)
        run = np.concatenate([[np.uint64(0)], np.cumsum((buf + np.uint64(1)) * up[: len(buf)], dtype=np.uint64)])
        sep = np.flatnonzero((buf == 32) | (buf == 10))
        start, end = sep[:-1] + 1, sep[1:]
        line = np.cumsum(buf[sep[:-1]] == 10) - 1
        owner = np.array([o for o, _ in group])[line]
        n = np.bincount(line, minlength=len(group))
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        nth = np.arange(len(line)) - first[line]
        reach = np.minimum(WORDS, n[line])  # texts of fewer words have one shingle
        ok = np.flatnonzero(nth + reach <= n[line])
        a, b = start[ok], end[ok + reach[ok] - 1]
        hs.append(_mix((run[b] - run[a]) * down[a]))
        os_.append(owner[ok])

    for i, norm in enumerate(norms):
        for part in _parts(i, norm):
            group.append(part)
            size += len(part[1])
            if size >= BLOCK:
                flush()
                group, size = [], 0
    if group:
        flush()
    if not hs:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hs), np.concatenate(os_)


def _weights(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[new], owner[new], np.diff(np.concatenate([new, [len(h)]]))


def signatures(h: np.ndarray, owner: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """BagMinHash of n multisets given by shingle hashes with owners: uint64[n, m], 0 where empty."""
    h, owner, w = _weights(h, owner)
    state, of, low, wide, weight = [_mix(h)], [owner], [np.zeros(len(h))], [np.ones(len(h))], [w]
    k = 1
    while len(at := np.flatnonzero(w > (1 << (k - 1)))):  # the interval (2**(k-1), 2**k]
        state.append(_mix(h[at] + np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64))))
        of.append(owner[at])
        low.append(np.full(len(at), float(1 << (k - 1))))
        wide.append(np.full(len(at), float(1 << (k - 1))))
        weight.append(w[at])
        k += 1
    s, d, low, wide, weight = (np.concatenate(x) for x in (state, of, low, wide, weight))
    t = np.zeros(len(s))
    first, sig = np.full(n * m, np.inf), np.zeros(n * m, dtype=np.uint64)
    whole = low + wide <= weight
    scale = 1.0 / (1 << 53)
    while len(s):
        s = s + _GOLD
        x = _mix(s)
        t = t - np.log(((x >> np.uint64(11)) + np.uint64(1)) * scale) / wide
        y = _mix(x + _GOLD)
        idx = d * m + (y % np.uint64(m)).astype(np.int64)
        counts = whole if whole.all() else whole | (low + 1 + np.floor((_mix(y) >> np.uint64(11)) * scale * wide) <= weight)
        i, ti, xi = (idx, t, x) if counts is whole else (idx[counts], t[counts], x[counts])
        np.minimum.at(first, i, ti)
        hit = first[i] == ti
        sig[i[hit]] = xi[hit] | np.uint64(1)
        late = first.reshape(n, m).max(axis=1)
        live = t <= late[d]
        s, d, low, wide, weight, t, whole = s[live], d[live], low[live], wide[live], weight[live], t[live], whole[live]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64[n, BANDS]: one key a band, with the band's number in it."""
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (len(sig), 1))
    for r in range(ROWS):
        key = _mix(key ^ sig[:, r::ROWS][:, :BANDS])
    return key.view(np.int64)


def expanded(h: np.ndarray) -> np.ndarray:
    """A multiset as a sorted set: the i-th copy of a shingle gets a hash of its own."""
    h = np.sort(h)
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
    nth = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0)) if len(h) else np.zeros(0, dtype=np.int64)
    return np.sort(_mix(h + nth.astype(np.uint64) * _GOLD))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


BASE = pa.schema(
    [("doc_id", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]
)
_BASE = "doc_id long, x1 long, x2 long, w1 long, w2 long, n long, bands array<long>, sig binary"


def _content(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(F.lit(1), t).alias("x1"), F.xxhash64(F.lit(2), t).alias("x2")]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= 4 * BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sign(batches):
    for b in batches:
        texts = b.column(3).to_pylist()
        for lo, hi in _chunks(texts):
            norms = [normalized(t) for t in texts[lo:hi]]
            h, owner = shingles(norms)
            n = hi - lo
            sig = signatures(h, owner, n)
            count = np.bincount(owner, minlength=n)
            digest = np.frombuffer(b"".join(hashlib.md5(x).digest() for x in norms), dtype="<i8").reshape(n, 2)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(band_keys(sig).ravel(), pa.int64()))
            small = (sig >> np.uint64(8)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).slice(lo, n) for i in range(3)), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.array(count, pa.int64()), keys, pa.array([x.tobytes() for x in small], pa.binary())],
                schema=BASE,
            )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: each node's neighbours move to its smallest one.

    A component's root may hold a third of all edges, so minima are taken, and brought back, by salted parts of a node.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.filter("u > v")
    both = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = both.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"])
    if large:
        out = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """u -> v, the smallest node of u's component, for every node that is not itself the smallest.

    Alternating large-star and small-star steps; tables between them are written to shared storage.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    state, now = None, materialize(edges, "star")
    while True:
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == state:
            return now
        state, old = mark, now
        now = materialize(_star(_star(now, True), False), "star")
        discard(old)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets are similar, as links u, v."""

    def check(batches):
        for b in batches:
            pairs = [np.frombuffer(x, dtype=np.uint64) for x in b.column(2).to_pylist()], [np.frombuffer(x, dtype=np.uint64) for x in b.column(3).to_pylist()]
            ok = [min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)) and similarity(x, y) >= SIMILAR for x, y in zip(*pairs, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("ia"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ia", "ib").mapInArrow(lean(check), "u long, v long")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sizes and signatures allow the similarity."""

    def check(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, M) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= LIKELY))

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    near = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") >= SIMILAR * F.greatest("na", "nb"))
    return near.select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long")


def _groups(batches, *keys: str) -> Iterator[pa.Table]:
    """Sorted batches as one table for each run of equal keys."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and tuple(k[lo]) != key:
                yield pa.Table.from_batches(held)
                held = []
            key = tuple(k[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _open_members(batches):
    """Of each block (key, i, j), the nodes with a likely partner in another component.

    A pair counts in the first band in which it meets, so that it is looked at once.
    """
    for rows in _groups(batches, "key", "i", "j"):
        side, node, comp, n = (rows.column(c).to_numpy() for c in ("side", "node", "comp", "n"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, M)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        key = rows.column("key")[0].as_py()
        a = np.flatnonzero(side <= 1)  # 0: block i; 2: block j; 1: both, i = j
        b = np.flatnonzero(side >= 1)
        b = b[np.argsort(n[b], kind="stable")]
        open_ = np.zeros(len(node), dtype=bool)
        for x in a:
            lo, hi = np.searchsorted(n[b], [SIMILAR * n[x] - 1e-9, n[x] / SIMILAR + 1e-9])
            y = b[lo:hi]
            y = y[comp[y] != comp[x]]
            y = y[(sig[y] == sig[x]).mean(axis=1) >= LIKELY] if len(y) else y
            if len(y):
                before = int(np.argmax(bands[x] == key))
                y = y[~(bands[y][:, :before] == bands[x][:before]).any(axis=1)]
                open_[y] = True
                open_[x] |= len(y) > 0
        if open_.any():
            yield pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().filter(pa.array(open_)) for c in ("key", "i", "j", "node", "comp")], names=["key", "i", "j", "node", "comp"])


def _links_inside(batches):
    """Of each block, exact links that join its components: at most one fewer than it has nodes."""
    for rows in _groups(batches, "key", "i", "j"):
        node, comp = rows.column("node").to_numpy(), rows.column("comp").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("items")]  # views, no copies
        size = np.array([len(x) for x in sets])
        _, group = np.unique(comp, return_inverse=True)
        out = []
        for x in range(len(sets)):
            # later nodes only: each pair is looked at once
            y = np.flatnonzero((group != group[x]) & (np.arange(len(sets)) > x) & (size >= SIMILAR * size[x] - 1e-9) & (size <= size[x] / SIMILAR + 1e-9))
            for k in y.tolist():
                if group[k] != group[x] and similarity(sets[x], sets[k]) >= SIMILAR:
                    out.append((node[x], node[k]))
                    group[group == group[k]] = group[x]
        if out:
            got = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["u", "v"])


def _late_links(multi: DataFrame, nodes: DataFrame, comp: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across components in the buckets that hold more than one.

    A bucket's largest component, its lead, needs no comparison with itself, only with the bucket's other
    nodes. Blocks of the others are met with each other and with the parts of the lead, so a bucket's rows
    stay linear in its lead. Blocks hold at most MEMBERS nodes and about ITEMS shingles on each side, parts of
    the lead LEAD nodes or as many as there are others. Signatures tell which nodes of a block can have a
    partner in it; only for those the multisets are fetched, and compared in the block.
    """
    rows = multi.select("key", "node").join(comp.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    rows = rows.join(nodes.select("node", "n"), "node")
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("items"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("size", "items", "comp")).alias("lead"), F.count(F.lit(1)).alias("comps"), F.sum("size").alias("size"), F.sum("items").alias("items")).filter("comps > 1")
    size, items = F.col("size") - F.col("lead.size"), F.col("items") - F.col("lead.items")
    part = F.least(F.lit(MEMBERS), F.greatest(F.lit(LEAD), size))
    blocks = mixed.select(
        "key",
        F.col("lead.comp").alias("lead"),
        F.ceil(F.greatest(size / MEMBERS, items / ITEMS)).cast("int").alias("blocks"),
        F.ceil(F.greatest(F.col("lead.size") / part, F.col("lead.items") / ITEMS)).cast("int").alias("parts"),
    )
    # blocks of the others count from 0, the lead's parts go on from there
    leads, at = F.col("comp") == F.col("lead"), F.xxhash64("node")
    inside = (
        rows.join(blocks, "key")
        .join(nodes.select("node", "sig", "bands"), "node")
        .withColumn("mine", F.when(leads, F.col("blocks") + F.pmod(at, F.col("parts"))).otherwise(F.pmod(at, F.col("blocks"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(leads, F.col("blocks") - 1).otherwise(F.col("blocks") + F.col("parts") - 1))))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.when(F.col("mine") == F.col("other"), 1).when(F.col("mine") < F.col("other"), 0).otherwise(2).alias("side"), "node", "comp", "n", "sig", "bands")
    )
    found = inside.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_open_members), "key long, i int, j int, node long, comp long")
    full = found.join(sets, "node")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(_links_inside), "u long, v long")


def _stars(multi: DataFrame) -> DataFrame:
    """Every node of a bucket with the bucket's smallest and largest."""
    ends = multi.select("node", F.explode(F.array("rep", "last")).alias("end")).filter("node <> end")
    return ends.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def _short(rows: DataFrame) -> DataFrame:
    """A written list of narrow rows, to be broadcast if it is short, so that whole texts need no shuffle to meet it."""
    return F.broadcast(rows) if rows.count() <= SHORT else rows


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per distinct words: w1, w2, stays (the row that stays), class_size."""
    ship(docs.sparkSession)
    text = docs.select(docs[id_col].cast("long").alias("doc_id"), *_content(docs[text_col]), docs[text_col].alias("text"))
    base = materialize(text.mapInArrow(lean(_sign), _BASE), "near-base")
    ranked = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "x1", "x2", "bands", "sig", "n")
    nodes = materialize(
        base.filter("n > 0")
        .groupBy("w1", "w2")
        .agg(F.min(ranked).alias("rep"), F.count(F.lit(1)).alias("rows"))
        .select("w1", "w2", "rows", "rep.doc_id", "rep.x1", "rep.x2", "rep.bands", "rep.sig", "rep.n", F.monotonically_increasing_id().alias("node")),
        "near-nodes",
    )
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("rep"), F.max("node").alias("last")).filter("last > rep")
    multi = materialize(buckets.join(shared, "key"), "near-buckets")
    stars = materialize(_likely(_stars(multi), nodes), "near-stars")

    wanted = materialize(multi.select("node").distinct().join(nodes.select("node", "doc_id", "x1", "x2"), "node"), "near-wanted")
    whole = text.alias("t").join(
        _short(wanted).alias("k"), (F.col("t.x1") == F.col("k.x1")) & (F.col("t.x2") == F.col("k.x2")) & F.col("t.doc_id").eqNullSafe(F.col("k.doc_id"))
    ).select("k.node", "t.text")

    def items(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                h, owner = shingles([normalized(t) for t in texts[lo:hi]])
                cut = np.searchsorted(owner, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array([expanded(h[x:y]).tobytes() for x, y in zip(cut, cut[1:], strict=False)], pa.binary())], names=["node", "items"]
                )

    # rows repeated with the same id and text would come twice
    sets = materialize(whole.mapInArrow(lean(items), "node long, items binary").dropDuplicates(["node"]), "near-sets")
    links = materialize(_verified(stars, sets), "near-links")
    comp = components(links)
    more = materialize(_late_links(multi, nodes, comp, sets), "near-more")
    if not more.isEmpty():
        comp = components(comp.unionByName(more))
    for t in (sets, stars, multi):
        discard(t)
    labelled = nodes.select("w1", "w2", "doc_id", "x1", "x2", "rows", "node").join(comp.select(F.col("u").alias("node"), "v"), "node", "left").withColumn("root", F.coalesce("v", "node"))
    stays = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "x1", "x2")
    roots = labelled.groupBy("root").agg(F.min(stays).alias("stays"), F.sum("rows").alias("class_size"))
    return base, labelled.select("w1", "w2", "root").join(roots, "root").select("w1", "w2", "stays", "class_size")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, class_id, class_size, kept (the class's document that stays)."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")
    rows = _judged(docs, id_col, text_col).select("*", copies)
    return rows.select("doc_id", "class_id", "class_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"))


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per distinct id and text, with its copies and whether it stays."""
    base, classes = _classes(docs, id_col, text_col)
    # copies of a row meet before the join, on the map side
    rows = base.groupBy("doc_id", "x1", "x2", "w1", "w2", "n").agg(F.count(F.lit(1)).alias("copies"))
    known = classes.withColumnsRenamed({"w1": "c1", "w2": "c2"})
    worded = rows.filter("n > 0").join(known, (F.col("w1") == F.col("c1")) & (F.col("w2") == F.col("c2")))
    own = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("x1") == F.col("stays.x1")) & (F.col("x2") == F.col("stays.x2"))
    return worded.select("doc_id", "x1", "x2", "copies", F.col("stays.doc_id").alias("class_id"), "class_size", own.alias("stays")).unionByName(
        rows.filter("n = 0").select("doc_id", "x1", "x2", "copies", F.col("doc_id").alias("class_id"), F.col("copies").alias("class_size"), F.lit(True).alias("stays"))
    )


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one document of each class. Rows that go are told by id and text hash."""
    judged = _judged(docs, id_col, text_col).filter(~F.col("stays") | (F.col("copies") > 1))
    told = materialize(judged.select(F.col("doc_id").alias("kd"), F.col("x1").alias("k1"), F.col("x2").alias("k2"), "stays"), "near-told")
    a, b = (fresh(docs.columns, f"_near_{x}") for x in ("a", "b"))
    c1, c2 = _content(F.col(text_col))
    rows = docs.withColumns({a: c1, b: c2})

    def same(listed: DataFrame) -> Column:
        return rows[id_col].cast("long").eqNullSafe(listed["kd"]) & (rows[a] == listed["k1"]) & (rows[b] == listed["k2"])

    gone, again = told.filter("not stays"), told.filter("stays")
    stay = rows.join(_short(gone), same(gone), "left_anti")
    if again.isEmpty():
        return stay.select(*docs.columns)
    # of rows that repeat, any one; the map side keeps one a task
    repeated = stay.join(_short(again), same(again), "left_semi").groupBy(id_col, a, b).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return stay.join(_short(again), same(again), "left_anti").select(*docs.columns).unionByName(repeated.select("row.*"))
