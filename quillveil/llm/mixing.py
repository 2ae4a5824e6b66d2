"""Mixing sources to target weights.

Per source, words are laid end to end (rows in a hashed order) and cut into fixed-length blocks.
Sources by code point, null last, weigh 3, 1, 2, repeating; together they want 150 % of all words;
a target stops at twice its source's size and the excess goes to the others by weight.
Each output shard draws its source counts by a multinomial over what the sources have left; a count above what is left
is cut and the rest drawn again, so that totals meet the targets, by the same law at every size. A source's j-th slot maps
through that source's pseudorandom permutation of block indices, one permutation per epoch, and
blocks are joined by index. The last slot of a source takes only the words still missing.

A word is a run of characters other than space and \\t-\\r; null text has none. Rows without words
take 0. Repeated ids are separate rows; null ids and null sources are values like others. An empty
table gives an empty result. All draws are seeded by position, so reruns agree.

A source may hold any share of the rows: its rows are laid out in hashed buckets, as many as a bucket has
rows (the root of their number), and only bucket totals are put in sequence, in a table of their own. The driver holds one row per source,
and per source and output shard; there are at most ``max_shards`` shards, fewer where sources are many, and the slots of a
shard are generated in chunks of bounded length.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import lean, materialize, ship

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Slots that one row of a shard becomes at once.
CHUNK = 4096


def allot(sizes: list[int], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Water-filling: ``share`` of all sizes by weight, no target above ``cap`` times its size."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], share * sum(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = cap * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in full]
    return target


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROUNDS = [np.uint64((r * 0x9E3779B97F4A7C15) & (2**64 - 1)) for r in (1, 2, 3, 4)]


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(n) at i, or its inverse: a four-round Feistel network, walked until inside."""
    n = n.astype(np.uint64)
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.unique(n)], dtype=np.uint64)
    half = half[np.searchsorted(np.unique(n), n)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, live = i.astype(np.uint64), np.arange(len(i))
    rounds = [_mix64(key.astype(np.uint64) + c) for c in (_ROUNDS[::-1] if back else _ROUNDS)]
    while len(live):
        left, right = out[live] >> half[live], out[live] & mask[live]
        for k in rounds:
            if back:
                left, right = right ^ (_mix64(left + k[live]) & mask[live]), left
            else:
                left, right = right, left ^ (_mix64(right + k[live]) & mask[live])
        out[live] = (left << half[live]) | right
        live = live[out[live] >= n[live]]
    return out.astype(np.int64)


def _plan(sizes: list[int], targets: list[float], block: int) -> list[dict]:
    """Per source: its blocks, its slots, and the words its last slot takes."""
    out = []
    for s, (size, target) in enumerate(zip(sizes, targets, strict=True)):
        want, blocks = min(round(target), 2 * size), -(-size // block)
        epoch, rest = divmod(want, size) if size else (0, 0)
        slots, last = epoch * blocks, block
        if rest:
            n, lack = -(-rest // block), blocks * block - size
            at = int(permuted(np.array([blocks - 1]), np.array([blocks]), np.array([_key(s, epoch)]), back=True)[0])
            if n * block - lack * (at < n) < rest:  # the short block is among them
                n += 1
            slots, last = slots + n, int(rest - (n - 1) * block + lack * (at < n - 1))
        out.append({"blocks": blocks, "slots": slots, "last": last})
    return out


def _key(source: int, epoch: int) -> int:
    return (source * 1_000_003 + epoch * 7919 + 17) & ((1 << 62) - 1)


def _draws(slots: list[int], max_shards: int, least: int = 256) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot of that source, count) for every output shard."""
    left, total = np.array(slots, dtype=np.int64), sum(slots)
    per = max(least, -(-total // max_shards))
    rng, first, out = np.random.default_rng(20), np.zeros(len(slots), dtype=np.int64), []
    for shard in range(-(-total // per)):
        got = _draw(rng, left, min(per, int(left.sum())))
        for s in np.flatnonzero(got):
            out.append((shard, int(s), int(first[s]), int(got[s])))
        first, left = first + got, left - got
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n slots by a multinomial over what is left of each source, held inside it."""
    got = np.zeros(len(left), dtype=np.int64)
    while (lack := n - int(got.sum())) > 0:
        room = left - got
        got += np.minimum(rng.multinomial(lack, room / room.sum()), room)
    return got


def _layout(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: list[str]):
    """Stored rows (uid and carried columns); uid, doc_id, source, s, size, start of each; the sources' sizes."""
    stored = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),  # written once, so it stays
            docs[id_col].alias("doc_id"),
            docs[source_col].cast("string").alias("source"),
            F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(docs[id_col], docs[text_col]).alias("place"),
            *[docs[c].alias(f"keep_{i}") for i, c in enumerate(carry)],
        ),
        "mix-rows",
    )
    per_source = stored.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # one row a source
    per_source.sort(key=lambda x: (x.source is None, x.source or ""))
    names = [(i, x.source, math.isqrt(x.n) + 1) for i, x in enumerate(per_source)]
    table = docs.sparkSession.createDataFrame(names, "s int, source_ string, buckets long")
    own = stored.select("uid", "doc_id", "source", "size", "place").join(_small(table, len(names)), F.col("source").eqNullSafe(F.col("source_")))
    own = own.withColumn("salt", F.pmod("place", F.col("buckets"))).drop("source_", "buckets")
    ahead = Window.partitionBy("s").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = own.groupBy("s", "salt").agg(F.sum("size").alias("total")).select("s", "salt", (F.sum("total").over(ahead) - F.col("total")).alias("bucket_start"))
    order = Window.partitionBy("s", "salt").orderBy("place", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        own.withColumn("ahead", F.sum("size").over(order) - F.col("size"))
        .join(starts, ["s", "salt"])
        .select("uid", "doc_id", "source", "s", "size", (F.col("bucket_start") + F.col("ahead")).alias("start"))
    )
    return stored, materialize(rows, "mix-layout"), [x["size"] for x in per_source]


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of one row a source, broadcast where it is small; sources are few in practice, but not by nature."""
    return F.broadcast(table) if rows <= 100_000 else table


def _slots(spark, plan: list[dict], max_shards: int, block: int) -> DataFrame:
    """One row per slot: shard, s, block (index), epoch, take (words)."""
    ship(spark)
    draws = _draws([p["slots"] for p in plan], max(1, min(max_shards, 4_000_000 // max(1, len(plan)))))
    per_source = spark.createDataFrame([(i, p["blocks"], p["slots"], p["last"]) for i, p in enumerate(plan)] or [(-1, 1, 0, 0)], "s int, blocks long, n_slots long, last long")
    frame = spark.createDataFrame(draws, "shard int, s int, first long, n long")
    slots = (
        frame.select("shard", "s", (F.col("first") + F.col("n")).alias("end"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("first"))
        .repartition("shard", "s", "first")
        .select("shard", "s", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("end")) - 1)).alias("j"))
        .join(_small(per_source, len(plan)), "s")
        .select("shard", "s", (F.col("j") % F.col("blocks")).alias("pos"), F.floor(F.col("j") / F.col("blocks")).cast("int").alias("epoch"), "blocks", F.when(F.col("j") == F.col("n_slots") - 1, F.col("last")).otherwise(F.lit(block)).cast("long").alias("take"))
    )

    def mapped(batches):
        for b in batches:
            key = (b["s"].to_numpy() * 1_000_003 + b["epoch"].to_numpy() * 7919 + 17).astype(np.int64)
            yield pd.DataFrame({"shard": b["shard"], "s": b["s"], "block": permuted(b["pos"].to_numpy(), b["blocks"].to_numpy(), key), "epoch": b["epoch"], "take": b["take"]})

    return slots.mapInPandas(lean(mapped), "shard int, s int, block long, epoch int, take long")


def _taken(rows: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Pieces of rows met with the slots that take their block: from (in the row), words, epoch, shard."""
    b = F.lit(block).cast("long")
    end = F.col("start") + F.col("size")
    pieces = rows.filter("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block")).select(
        "*", F.greatest(F.col("start"), F.col("block") * b).alias("lo"), F.least(end, (F.col("block") + 1) * b).alias("hi")
    )
    return (
        pieces.join(slots, ["s", "block"])
        .withColumn("hi", F.least(F.col("hi"), F.col("block") * b + F.col("take")))
        .filter("hi > lo")
        .withColumn("offset", F.col("lo") - F.col("start"))
        .withColumn("words", F.col("hi") - F.col("lo"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 512, max_shards: int = 4096) -> DataFrame:
    """One row per row: doc_id, size, source, source_size, target, taken."""
    spark = docs.sparkSession
    _, rows, sizes = _layout(docs, id_col, text_col, source_col, [])
    targets = allot(sizes, [WEIGHTS[i % 3] for i in range(len(sizes))])
    slots = _slots(spark, _plan(sizes, targets, block), max_shards, block)
    per_source = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(sizes, targets, strict=True))], "s int, source_size long, target double")
    got = _taken(rows.select("uid", "s", "start", "size"), slots, block).groupBy("uid").agg(F.sum("words").alias("taken"))
    return (
        rows.join(got, "uid", "left")
        .join(_small(per_source, len(sizes)), "s")
        .select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mix_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 512, max_shards: int = 4096) -> DataFrame:
    """The mix itself, in the columns of ``docs``: one row per row and epoch with the words taken.

    A row whose words are all taken keeps its text as it stands; else each run of taken words is cut
    from the text, and runs are joined by a newline.
    """
    spark = docs.sparkSession
    stored, rows, sizes = _layout(docs, id_col, text_col, source_col, docs.columns)
    targets = allot(sizes, [WEIGHTS[i % 3] for i in range(len(sizes))])
    slots = _slots(spark, _plan(sizes, targets, block), max_shards, block)
    got = (
        _taken(rows.select("uid", "s", "start", "size"), slots, block)
        .groupBy("uid", "epoch")
        .agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("offset", "words"))).alias("runs"))  # a row's own blocks
    )
    at = docs.columns.index(text_col)
    t = F.col(f"keep_{at}")

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_cut(x, r) for x, r in zip(text, runs, strict=True)], dtype=object)

    joined = stored.join(got, "uid")
    whole = joined.filter("words = size")
    part = joined.filter("words < size").withColumn(f"keep_{at}", cut(t, F.col("runs")))
    cols = [F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)]
    return whole.select(*cols).unionByName(part.select(*cols))


def _cut(text: str, runs) -> str:
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    merged: list[list[int]] = []
    for r in runs:
        if merged and merged[-1][1] == r["offset"]:
            merged[-1][1] += r["words"]
        else:
            merged.append([r["offset"], r["offset"] + r["words"]])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in merged)
