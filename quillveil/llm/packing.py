"""Packing by Karmarkar-Karp multiway differencing.

A document is its token ids and the end id. Ids are cut at every full window; the rest of a
document is cut at ``piece`` ids, so that windows hold several pieces. Pieces are dealt at random to
groups of about ``group`` pieces. In a group, differencing keeps a heap of partial partitions into k
windows, merges the two with the largest imbalance, largest window of one with the smallest of
the other, until one partition is left; its windows are near equal. k starts at the least number
that could hold the ids and rises whenever a window exceeds the capacity.

Null text is empty and packs its end id alone. Repeated rows are packed each; ties are broken by id
and start. An empty table gives an empty result. Only the id and the text are read.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` with the tokenizer file as it is; strings of its
added tokens in a text give those tokens. No piece of the tokenizer's splitting crosses white space, so texts are cut
there, and each distinct run of other characters in a batch is encoded once; short runs stay in a memory of bounded
size. Runs of plain Latin characters are encoded in bulk by a rank-based merger over the same vocabulary, all others, and
those with an added token, by the tokenizer itself. Texts beyond ``BLOCK`` characters are worked off in blocks that end at white space.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import lean, materialize, ship, trim

WINDOW, END_ID = 4096, 2
BLOCK, MEMORY, LONGEST = 1 << 18, 300_000, 48


def _plain(c: str) -> bool:
    """Lower-casing and composition leave the character one to one, inside the letters that ``_PIECES`` knows."""
    return "!" <= c <= "~" or ("À" <= c <= "ɏ" and c not in "×÷" and len(c.lower()) == 1 and "ß" <= c.lower() <= "ɏ")


_PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x21, 0x250) if _plain(chr(c))) + "]+")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-ɏ]+|[0-9]|[^a-z0-9ß-ɏ]+")
# Characters at which str.split cuts and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _bytes_of_symbols() -> dict[str, int]:
    """Byte-level vocabularies write byte b as a printable character: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Encoder:
    """Token ids of texts, as the tokenizer file at ``path`` gives them."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        self.added = re.compile("|".join(re.escape(x["content"]) for x in told["added_tokens"]) or r"(?!)")
        end, of = "</w>", _bytes_of_symbols()
        # byte 1 stands for the word's end: it comes after every word and never inside a plain one
        as_bytes = lambda s: bytes(of[c] for c in s.removesuffix(end)) + b"\x01" * s.endswith(end)
        ranks = {bytes([b, 1]): b for b in range(256)} | {bytes([b]): 256 + b for b in range(256)}
        for i, merge in enumerate(model["merges"]):
            ranks[as_bytes("".join(merge if isinstance(merge, list) else merge.split(" ")))] = 512 + i
        self.ids = np.zeros(512 + len(model["merges"]), dtype="<u4")
        self.ends = np.zeros(len(self.ids), dtype=bool)
        for s, i in model["vocab"].items():
            if not s.startswith("<|") and (r := ranks.get(as_bytes(s))) is not None:
                self.ids[r], self.ends[r] = i, s.endswith(end)
        self.bulk = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, runs: set[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        cut: dict[str, list[str]] = {}
        for run in runs:
            if _PLAIN.fullmatch(run) and not self.added.search(run):
                cut[run] = _PIECES.findall(run.lower())
            else:
                out[run] = np.array(self.exact.encode(run, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = {w for ws in cut.values() for w in ws}
        new = list(words.difference(self.words))
        once: dict[str, bytes] = {}
        if new:
            got = np.array(self.bulk.encode_ordinary("\x01 ".join(new) + "\x01"), dtype=np.int64)
            ids, stops = self.ids[got], np.flatnonzero(self.ends[got]) + 1
            start = 0
            for w, stop in zip(new, stops.tolist(), strict=True):
                (self.words if len(w) <= LONGEST else once)[w] = ids[start:stop].tobytes()
                start = stop
        for run, ws in cut.items():
            out[run] = b"".join([self.words[w] if len(w) <= LONGEST else once[w] for w in ws])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if len(self.known) > MEMORY or len(self.words) > MEMORY:
            self.known, self.words = {}, {}
            trim()
        runs = [None if _ODD_SPACE.search(t) else t.split() for t in texts]
        known, learned = self.known, self._learn({r for rs in runs if rs for r in rs}.difference(self.known))
        known.update({r: x for r, x in learned.items() if len(r) <= LONGEST})
        if any(len(r) > LONGEST for r in learned):  # long runs are not remembered
            known = {**known, **learned}
        return [
            np.array(self.exact.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() if rs is None else b"".join([known[r] for r in rs])
            for t, rs in zip(texts, runs, strict=True)
        ]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


_SPACE = re.compile(r"[ \n\t\r]")


def _blocks(text: str) -> Iterator[str]:
    """A long text in parts of about BLOCK characters that end before white space; a run longer than that stays whole."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Cutter:
    """Takes a document's ids in parts and gives (start, length, crc32) of its pieces."""

    def __init__(self, window: int, piece: int):
        self.window, self.piece, self.rest, self.start = window, piece, b"", 0

    def _cut(self, n: int) -> tuple[int, int, int]:
        part, self.rest = self.rest[: 4 * n], self.rest[4 * n :]
        self.start += n
        return self.start - n, n, zlib.crc32(part)

    def add(self, ids: bytes) -> Iterator[tuple[int, int, int]]:
        whole = self.rest + ids
        done = len(whole) // (4 * self.window) * 4 * self.window
        for at in range(0, done, 4 * self.window):
            yield self.start, self.window, zlib.crc32(whole[at : at + 4 * self.window])
            self.start += self.window
        self.rest = whole[done:]

    def end(self) -> Iterator[tuple[int, int, int]]:
        parts = -(-len(self.rest) // (4 * self.piece))
        for i in range(parts):  # nearly equal, none above piece
            yield self._cut(-(-(len(self.rest) // 4) // (parts - i)))


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int, piece: int) -> DataFrame:
    """All pieces of all rows: doc_id, start, length, ids_crc32, doc_tokens."""
    ship(docs.sparkSession)
    last = np.array([END_ID], dtype="<u4").tobytes()

    def rows(ids: list, texts: list[str]) -> Iterator[tuple]:
        for i, parts in zip(ids, encoder(tokenizer).encode(texts), strict=True):
            c = Cutter(window, piece)
            found = [*c.add(parts + last), *c.end()]
            yield from ((i, *f, c.start) for f in found)

    def long_row(i, text: str) -> Iterator[tuple]:
        c, found = Cutter(window, piece), []
        for part in _blocks(text):
            found += c.add(encoder(tokenizer).encode([part])[0])
        found += [*c.add(last), *c.end()]
        yield from ((i, *f, c.start) for f in found)

    def run(batches):
        for b in batches:
            got, ids, texts, size = [], [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(t or "") > BLOCK:
                    got += long_row(i, t)
                    continue
                ids.append(i)
                texts.append(t or "")
                size += len(t or "")
                if size > 4 * BLOCK:
                    got += rows(ids, texts)
                    ids, texts, size = [], [], 0
            got += rows(ids, texts) if ids else []
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*got, strict=True), PIECES, strict=True)], schema=PIECES)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp into k windows: the window of each item, and the windows' sums."""
    n = len(lengths)
    if k == 1:
        return np.zeros(n, dtype=np.int64), np.array([lengths.sum()])
    # A partition has k sums, descending, and for each the top of a tree of items: leaves are 0..n-1.
    left, right = [], []
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, x in enumerate(lengths.tolist()):
        heap.append((-x, i, np.array([x]), np.array([i])))  # the k - 1 zeros are implied
    heapq.heapify(heap)
    stamp = n
    while len(heap) > 1:
        _, _, s1, t1 = heapq.heappop(heap)
        _, _, s2, t2 = heapq.heappop(heap)
        if len(s1) + len(s2) <= k:  # nothing has to share a window
            sums, tops = np.concatenate([s1, s2]), np.concatenate([t1, t2])
        else:
            if len(s1) < len(s2):
                s1, t1, s2, t2 = s2, t2, s1, t1
            free = k - len(s1)  # the implied zeros of the first take the largest of the second
            both = len(s2) - free
            shared = s1[len(s1) - both :] + s2[free:][::-1]
            new = np.arange(len(left), len(left) + both) + n
            left.extend(t1[len(s1) - both :].tolist())
            right.extend(t2[free:][::-1].tolist())
            sums = np.concatenate([s1[: len(s1) - both], s2[:free], shared])
            tops = np.concatenate([t1[: len(t1) - both], t2[:free], new])
        order = np.argsort(-sums, kind="stable")
        sums, tops = sums[order], tops[order]
        low = sums[-1] if len(sums) == k else 0
        heapq.heappush(heap, (-int(sums[0] - low), stamp, sums, tops))
        stamp += 1
    _, _, sums, tops = heap[0]
    of = np.empty(n + len(left), dtype=np.int64)
    of[tops] = np.arange(len(tops))
    for v in range(len(left) - 1, -1, -1):
        of[left[v]] = of[right[v]] = of[n + v]
    return of[:n], sums


def pack_lengths(lengths: np.ndarray, window: int) -> np.ndarray:
    """The window of each length; the number of windows rises while any is too full."""
    k = max(1, -(-int(lengths.sum()) // window))
    while True:
        of, sums = differencing(lengths, k)
        if sums.max() <= window:
            return of
        k = max(k + 1, k + k // 200)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = 1024, group: int = 1024) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    stored = materialize(pieces(docs, tokenizer, id_col, text_col, window, piece).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    groups = max(1, round(stored.count() / group))
    ship(spark)

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "uid"], ascending=[False, True, True, True], ignore_index=True)
        n = pdf["length"].to_numpy()
        full = n >= window
        of = np.empty(len(n), dtype=np.int64)
        of[full] = np.arange(full.sum())
        if not full.all():
            of[~full] = pack_lengths(n[~full], window) + full.sum()
        order = np.argsort(of, kind="stable")
        pdf, of = pdf.iloc[order], of[order]
        pdf["sequence_id"] = of + (int(key[0]) << 32)
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return stored.withColumn("g", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("g").applyInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
