"""Language identification by bit-sliced Bloom filters of character n-grams.

Every slot of the filter holds one bit per language. The AND of an n-gram's slots gives all
languages whose filter contains it; per language the hits are counted over a text, corrected for
that language's false-positive rate, and the largest share decides (ties: first language by name).
Each language enters its ``top`` most frequent n-grams, counted over a bounded sample of labelled
rows (``sample_docs`` a language); that is the only bound, and prediction reads whole texts.

N-grams are runs of 3 and 4 characters inside a word, with at most its two borders; letters are
lower-cased. Null text and text without letters give ``und`` with score 0, as does a table from
which nothing can be learned. Null labels are not learned from; repeated rows count each. Other
columns are not read, and label, source and id never enter a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import lean, ship

BLOCK = 1 << 18
PROBES = 3
_TABLE: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _TABLE[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of texts of at most BLOCK characters in all; long texts overlap by the n-gram's reach."""
    owners, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t or ""), BLOCK):
            part = t[max(0, at - 3) : at + BLOCK]
            if size + len(part) > BLOCK and parts:
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield owners, parts


def ngrams(owners: list[int], parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams, the owner of each, and the owners that have letters."""
    low = [p.lower() for p in parts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.array(owners, dtype=np.int64), [len(p) + 1 for p in low])
    c = np.where(_is_letter()[codes], codes, 0).astype(np.uint64)
    inside = c != 0
    lettered = np.unique(owner[inside[1:]])
    prime = np.uint64(0x100000001B3)
    h3 = ((c[:-2] * prime + c[1:-1]) * prime + c[2:]) * prime
    ok3 = inside[1:-1]
    h4 = h3[:-1] + c[3:] + np.uint64(1 << 62)
    ok4 = inside[1:-2] & inside[2:-1]
    at3, at4 = np.flatnonzero(ok3), np.flatnonzero(ok4)
    return _mix(np.concatenate([h3[at3], h4[at4]])), np.concatenate([owner[at3], owner[at4]]), lettered


class Filter:
    """The bit-sliced filter: ``slots`` rows of 64-bit words, one bit a language."""

    def __init__(self, grams: dict[str, np.ndarray], bits_per_gram: int = 24):
        self.langs = sorted(grams)
        n = max(1, *(len(g) for g in grams.values())) if grams else 1
        self.slots = 1 << int(np.ceil(np.log2(n * bits_per_gram)))
        self.words = -(-max(1, len(self.langs)) // 64)
        self.table = np.zeros((self.slots, self.words), dtype=np.uint64)
        for i, lang in enumerate(self.langs):
            for at in self._probes(grams[lang].astype(np.uint64)):
                self.table[at, i // 64] |= np.uint64(1 << (i % 64))
        fill = np.array([np.mean((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(self.langs))])
        self.false = fill**PROBES

    def _probes(self, h: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64(self.slots - 1)
        for k in range(PROBES):
            yield ((h >> np.uint64(21 * k)) ^ (h * np.uint64(2 * k + 1))) & mask

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = None
        for at in self._probes(h):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        n, k = len(texts), len(self.langs)
        hits, total, letters = np.zeros((n, k)), np.zeros(n), np.zeros(n, dtype=bool)
        for owners, parts in _blocks(texts):
            h, owner, lettered = ngrams(owners, parts)
            letters[lettered] = True
            total += np.bincount(owner, minlength=n)
            if not k:
                continue
            m = self.masks(h)
            for i in range(k):
                hits[:, i] += np.bincount(owner, weights=(m[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), minlength=n)
        if not k:
            return ["und"] * n, [0.0] * n
        share = np.clip((hits / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false), 0, 1)
        best = share.argmax(axis=1)
        return (
            [self.langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)],
            [float(share[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))],
        )


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2 (null id: the empty text)."""
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 2000, top: int = 6000) -> Filter:
    """Learn from the rows that are not held out and have text and label."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).filter(
        ~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return Filter({})
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))])
    u = F.xxhash64(F.lit(7), "id", "text").bitwiseAND((1 << 52) - 1) / float(1 << 52)
    sample = rows.filter(u < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for owners, parts in _blocks(texts):
                h, owner, _ = ngrams(owners, parts)
                of = np.array(langs, dtype=object)[owner]
                for lang in set(of.tolist()):
                    grams, n = np.unique(h[of == lang], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(grams), "gram": grams.view(np.int64), "n": n.astype(np.int64)})

    by = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = by.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("gram")))).filter(F.col("r") <= top)
    best: dict[str, list[int]] = {lang: [] for lang in counts}
    for r in ranked.select("lang", "gram").collect():  # ``top`` rows a language at most
        best[r.lang].append(r.gram)
    return Filter({lang: np.array(grams, dtype=np.int64).view(np.uint64) for lang, grams in best.items() if grams})


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x top n-grams: bounded by parameters

    def run(batches):
        for b in batches:
            pred, score = shared.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=OUT)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text")).mapInArrow(
        lean(run), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def keep_identified(docs: DataFrame, model: Filter, text_col: str = "text", least: float = 0.15) -> DataFrame:
    """The rows whose text has a language: not ``und``, and a share of at least ``least`` of its n-grams.

    Texts of one or two letters are judged like others, by the n-grams that their letters make with the word's borders. Null text
    and text without letters go; repeated rows stay or go together; ``und`` is all that a model without languages says, so then
    every row goes.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def keep(batches):
        for b in batches:
            pred, score = shared.value.predict(b.column(at).to_pylist())
            ok = [p != "und" and s >= least for p, s in zip(pred, score, strict=True)]
            yield b.filter(pa.array(ok, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(lean(keep), docs.schema)
