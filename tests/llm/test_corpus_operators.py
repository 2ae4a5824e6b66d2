"""Dedup, sharding, mixing, packing, search: against brute force, with the awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillveil.llm import ann, exact_dedup, minhash, mixing, packing, queries, sharding
from quillveil.runtime import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h128 string, norm string, node long, shard int"


def frame(spark, rows):
    """(id, text, source) with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "h", "n", 1, 2) for i, t, s in rows], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


ROWS = [
    (1, "Same Text", "a"),
    (2, "same text", "b"),
    (3, "sAME tEXT", None),
    (4, None, "a"),
    (5, "", "a"),
    (6, "É", "a"),
    (7, "é", "a"),
    (8, "x " * 40_000, "b"),
    (8, "x " * 40_000, "b"),
    (None, "null id", "c"),
    (None, "null id", "c"),
    (9, "null id", "c"),
    (10, " same text", ""),
]

# ---------------------------------------------------------------- exact dedup


def test_exact_classes_brute_force(spark):
    got = Counter(tuple(r) for r in exact_dedup.exact_classes(frame(spark, ROWS)).collect())
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            want[(i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want


def test_exact_dedup_keeps_columns_and_one_row(spark):
    df = frame(spark, ROWS)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, lower(r.text)[:9]) for r in out.collect()) == sorted({(max((i or 0) for i, u, _ in ROWS if lower(u) == lower(t)), lower(t)[:9]) for _, t, _ in ROWS})
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0 and exact_dedup.exact_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())


# ---------------------------------------------------------------- sharding


def check_shards(rows, source):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(16):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / 16) <= 2 * largest
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    keys = [(r.text_crc32, -(2**63) if r.doc_id is None else r.doc_id) for r in order]
    assert keys == sorted(keys)  # one range after the other


def test_shards(spark, sf):
    rows = queries.op9_sampled_splitter_shards(spark, sf).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_shards_edges(spark):
    check_shards(sharding.shard(frame(spark, ROWS)).collect(), [(i, t) for i, t, _ in ROWS])
    assert sharding.shard(frame(spark, ROWS).limit(0)).count() == 0


def test_shards_subdivide_hot_ranges(spark):
    rows = [(i, "hot", "a") for i in range(3000)] + [(i, f"text {i}", "a") for i in range(3000, 6000)]
    got = sharding.shard(frame(spark, rows), ranges=8, samples=64, least_rows=100)
    check_shards(got.collect(), [(i, t) for i, t, _ in rows])


# ---------------------------------------------------------------- mixing


def test_allotment_stops_at_twice_the_size():
    sizes, weights = [1000, 10, 500], [3, 1, 2]
    got = mixing.allot(sizes, weights)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes))
    assert got[1] == 20
    assert mixing.allot([0, 0], [3, 1]) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    i, ns, key = np.arange(n), np.full(n, n), np.full(n, 12345)
    p = mixing.permuted(i, ns, key)
    assert sorted(p) == list(range(n)) and (mixing.permuted(p, ns, key, back=True) == i).all()


def brute_mix(rows, block=512):
    """The same plan carried out word by word over the laid out sources."""
    by = {}
    for r in rows:
        by.setdefault(r["s"], []).append(r)
    sizes = [sum(r["size"] for r in by[s]) for s in sorted(by)]
    targets = mixing.allot(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    plan, taken = mixing._plan(sizes, targets, block), Counter()
    for s, p in enumerate(plan):
        words = [None] * sizes[s]
        for r in by[s]:
            words[r["start"] : r["start"] + r["size"]] = [r["uid"]] * r["size"]
        assert None not in words
        for j in range(p["slots"]):
            b = mixing.permuted(np.array([j % p["blocks"]]), np.array([p["blocks"]]), np.array([mixing._key(s, j // p["blocks"])]))[0]
            run = words[b * block : (b + 1) * block]
            taken.update(run[: p["last"]] if j == p["slots"] - 1 else run)
    return taken


def test_mix_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    _, rows, sizes = mixing._layout(docs, "doc_id", "text", "source", [])
    want = brute_mix([r.asDict() for r in rows.collect()])
    of = {r.uid: r.doc_id for r in rows.collect()}
    got = {r.doc_id: r for r in queries.op4_block_mixing(spark, sf).collect()}
    assert len(got) == docs.count()
    assert {of[u]: n for u, n in want.items()} == {i: r.taken for i, r in got.items() if r.taken}
    source = {r.doc_id: r.source for r in docs.collect()}
    for s in set(source.values()):
        mine = [r for i, r in got.items() if source[i] == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
    assert all(r.taken <= 2 * r["size"] for r in got.values())
    again = {r.doc_id: r.taken for r in queries.op4_block_mixing(spark, sf).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mix_edges(spark):
    got = mixing.mix(frame(spark, ROWS)).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in got)
    names = sorted({s for *_, s in ROWS if s is not None}) + [None]
    size = {s: sum(len((t or "").split()) for _, t, u in ROWS if u == s) for s in names}
    want = dict(zip(names, mixing.allot([size[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])))
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 1
    assert mixing.mix(frame(spark, ROWS).limit(0)).count() == 0


def test_mix_texts_hold_the_words_taken(spark, sf):
    docs = table(spark, sf, "documents")
    out = mixing.mix_texts(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    assert mixing.mix_texts(docs.limit(0)).count() == 0


def test_draws_follow_one_law_at_every_size():
    """Ten thousand million slots go by the law that a hundred go by: counts near the shares of what is left, totals met."""
    rng = np.random.default_rng(1)
    for scale in (10, 10**9):
        slots = [6 * scale, 1 * scale, 3 * scale, 0]
        draws = mixing._draws(slots, 50, least=1)
        assert [sum(n for _, s, _, n in draws if s == i) for i in range(4)] == slots
        assert all(n > 0 for *_, n in draws)
    left = np.array([60, 10, 30])
    mean = np.mean([mixing._draw(rng, left, 20) for _ in range(4000)], axis=0)
    assert np.allclose(mean, 20 * left / left.sum(), atol=0.3)
    assert (mixing._draw(rng, left, 100) == left).all()


def test_draws_meet_totals():
    slots = [1000, 3, 0, 421]
    draws = mixing._draws(slots, 16, least=8)
    assert [sum(n for _, s, _, n in draws if s == i) for i in range(4)] == slots
    for i in range(4):
        starts = sorted((f, n) for _, s, f, n in draws if s == i)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


# ---------------------------------------------------------------- packing


def check_packing(rows, ids_of):
    docs = {}
    for r in rows:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for mine in windows.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
    for i, want in ids_of:
        found = sorted(r.start for r in docs[(i, len(want))])
        for r in docs[(i, len(want))]:
            part = np.array(want[r.start : r.start + r.length], dtype="<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert found[0] == 0
    assert sum(r.length for r in rows) == sum(len(w) for _, w in ids_of)
    return len(windows) * 4096 / sum(r.length for r in rows)


def exact_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_whole_table(spark, sf):
    docs = table(spark, sf, "documents").collect()
    rows = queries.op3_differencing_packing(spark, sf).collect()
    assert check_packing(rows, list(zip([r.doc_id for r in docs], exact_ids([r.text for r in docs])))) < 1.05


def test_packing_edges(spark):
    odd = ["don't I'LL", "ﬁ İstanbul ½ 你好 Ωμέγα ẞß ŉ", "a\x1cb c", "<|endoftext|>", "x" * 3000, "🙂é́ é", "l'été d'où"]
    rows = [(i, t, "a") for i, t, _ in ROWS] + [(100 + i, t, "a") for i, t in enumerate(odd)]
    got = packing.pack(frame(spark, rows), queries.tokenizer()).collect()
    check_packing(got, list(zip([i for i, *_ in rows], exact_ids([t for _, t, _ in rows]))))
    assert packing.pack(frame(spark, rows).limit(0), queries.tokenizer()).count() == 0


def test_packing_of_long_texts_by_blocks(spark, monkeypatch):
    text = " ".join(f"word{i} été," for i in range(200_000))
    assert len(text) > packing.BLOCK
    got = packing.pack(frame(spark, [(1, text, "a")]), queries.tokenizer()).collect()
    assert check_packing(got, [(1, exact_ids([text])[0])]) < 1.02


def test_encoder_agrees_on_every_character_and_added_tokens():
    e = packing.Encoder(queries.tokenizer())
    chars = [chr(c) for c in range(0x20, 0x250)]
    texts = [f"a{c}b {c} {c}{c} h{c}yat {c}a b{c} 1{c}2 '{c}s" for c in chars]
    texts += ["a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>", "<|ENDOFTEXT|>", "|<|endoftext|", "it'S don'T we'LL x'Re", "y" * 100 + "<|endoftext|>"]
    texts += [f"ab{chr(c)}cd" for c in [*range(0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    assert got == [x[:-1] for x in exact_ids(texts)]
    assert got == [np.frombuffer(x, "<u4").tolist() for t in texts for x in e.encode([t])]


def test_bulk_encoder_agrees_on_random_words():
    rng = random.Random(5)
    e = packing.Encoder(queries.tokenizer())
    letters = "abcdefghijklmnopqrstuvwxyzéèêëàâçîïôûüöäßñÉÜ'’-.,0123456789"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)]
    assert got == [x[:-1] for x in exact_ids(texts)]


def test_differencing_is_near_equal_and_complete():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1025, 600)
    k = -(-int(lengths.sum()) // 4096) + 1
    of, sums = packing.differencing(lengths, k)
    assert sorted(np.bincount(of, weights=lengths, minlength=k)) == sorted(sums.tolist()) and sums.max() - sums.min() < 100
    assert packing.pack_lengths(np.array([4000, 4000, 4000]), 4096).tolist() in ([0, 1, 2], [0, 2, 1], [1, 0, 2], [1, 2, 0], [2, 0, 1], [2, 1, 0])


# ---------------------------------------------------------------- near-dedup


def multiset(text):
    w = minhash.normalized(text).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a or b else 0.0


def brute_classes(rows):
    sets = [multiset(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8) or (not sets[i] and not sets[j] and rows[i] == rows[j]):
                group[root(i)] = root(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(root(i), []).append(rows[i][0])
    return Counter(tuple(sorted(map(str, x))) for x in out.values())


def classes_of(rows):
    out = {}
    for n, r in enumerate(rows):
        out.setdefault((r.class_id, r.class_size) if r.class_size > 1 else n, []).append(r)
    assert all(sum(r.kept for r in x) == 1 for x in out.values()), "one of each class stays"
    return Counter(tuple(sorted(str(r.doc_id) for r in x)) for x in out.values())


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, passage = [], [word() for _ in range(60)]
    for g in range(4):
        base = [word() for _ in range(120)]
        for k in range(6):  # chains and stars of near copies
            text = list(base)
            for _ in range(k):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    for _ in range(6):  # a shared passage is no near copy
        rows.append((len(rows), " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])))
    rows += [(len(rows) + i, t) for i, t in enumerate(["one two three", "One, two three!", "one two four", "a b c d e " * 30, "a b c d e " * 29, "a b c d e " * 10, "a b c d e"])]
    return rows


def test_near_classes_brute_force(spark):
    rows = near_rows() + [(200, None), (201, ""), (202, "..."), (202, "..."), (203, "x " * 30_000)]
    df = frame(spark, [(i, t, "a") for i, t in rows])
    assert classes_of(minhash.near_classes(df).collect()) == brute_classes(rows)


def test_near_classes_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert classes_of(queries.op1_bagminhash_near_dedup(spark, sf).collect()) == brute_classes(rows)


def test_near_edges(spark):
    df = frame(spark, ROWS)
    got = minhash.near_classes(df).collect()
    assert len(got) == len(ROWS)
    kept = minhash.near_dedup(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert minhash.near_classes(df.limit(0)).count() == 0 and minhash.near_dedup(df.limit(0)).count() == 0


def test_signature_is_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 2**63, 40).astype(np.uint64)
    a, b = rng.integers(1, 20, 40), rng.integers(1, 20, 40)
    h = np.concatenate([np.repeat(items, a), np.repeat(items, b)])
    owner = np.concatenate([np.zeros(a.sum(), dtype=np.int64), np.ones(b.sum(), dtype=np.int64)])
    sig = minhash.signatures(h, owner, 2, m=4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=4 * math.sqrt(want * (1 - want) / 4096))


def test_long_texts_by_parts_have_the_same_shingles(monkeypatch):
    norm = minhash.normalized(" ".join(f"w{i % 97} v{i}" for i in range(3000)))
    whole = np.sort(minhash.shingles([norm, b"a b c", b"", b"a b c d e f"])[0])
    monkeypatch.setattr(minhash, "BLOCK", 101)
    assert (np.sort(minhash.shingles([norm, b"a b c", b"", b"a b c d e f"])[0]) == whole).all() and len(whole) == 6000 - 4 + 1 + 2


def test_words_longer_than_a_part_hide_nothing(monkeypatch):
    rng = random.Random(7)

    def word(n):
        return "".join(rng.choice("abcdefghij") for _ in range(n))

    short = [word(rng.randint(1, 9)) for _ in range(400)]
    texts = [" ".join([word(300), *short]), " ".join([*short[:200], word(300), word(500), *short[200:], word(200)]), " ".join(word(rng.choice((3, 150))) for _ in range(200)), word(900)]
    norms = [minhash.normalized(t) for t in texts]
    whole = minhash.shingles(norms)
    monkeypatch.setattr(minhash, "BLOCK", 100)
    cut = minhash.shingles(norms)
    for i in range(len(texts)):
        assert sorted(whole[0][whole[1] == i].tolist()) == sorted(cut[0][cut[1] == i].tolist()), i


def test_a_first_word_longer_than_the_real_part():
    words = ["x" * (minhash.BLOCK + 5), *(f"w{i}" for i in range(300_000))]
    h, _ = minhash.shingles([minhash.normalized(" ".join(words))])
    assert len(h) == len(words) - 4


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 14), (5, 5), (20, 3)]
    got = {r.u: r.v for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 20: 1, 11: 10, 12: 10, 13: 10, 14: 10}


@pytest.mark.parametrize("members, lead", [(3, 2), (2, 1), (2048, 512)])
def test_buckets_in_blocks(spark, monkeypatch, members, lead):
    monkeypatch.setattr(minhash, "MEMBERS", members)
    monkeypatch.setattr(minhash, "LEAD", lead)
    rows, base = near_rows(), [f"w{i}" for i in range(200)]

    def changed(places):
        return " ".join(f"{w}x{max(places)}" if i in places else w for i, w in enumerate(base))

    for k in range(20):  # a large component, and strays that are near to one of its members only
        rows.append((1000 + k, changed({10 * k + 2})))
        if k % 4 == 0:
            rows.append((2000 + k, " ".join(f"y{k}" if i in {10 * ((k + 3 * j) % 20) + 7 for j in range(1, 5)} else w for i, w in enumerate(changed({10 * k + 2}).split()))))
    want = brute_classes(rows)
    assert max(len(c) for c in want) == 25
    assert classes_of(minhash.near_classes(frame(spark, [(i, t, "a") for i, t in rows])).collect()) == want


# ---------------------------------------------------------------- search


def brute_search(rows, k=10, every=100):
    sound = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(sound):
        if i % every == 0:
            out.setdefault(i, []).append(sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for m, (j, w) in enumerate(sound) if m != n)[:k])
    return out


def test_search_recall_and_exact_scores(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want = brute_search(rows)
    got = {}
    for r in queries.op2_balanced_posting_search(spark, sf).collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, mine in got.items():
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r.vec_id != q for r in mine)
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(r.score == pytest.approx(float(np.sqrt(((vectors[q] - vectors[r.vec_id]) ** 2).sum())), abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & {j for _, j in want[q][0]})
    assert hits >= 0.9 * 10 * len(want)


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (200, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(1000 + 7 * i, [1.0, 0.0]) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, node string")
    got = {}
    for r in ann.search(df).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute_search(rows)
    assert {q: sorted(x * len(want[q]) for x in ()) or len(v) for q, v in got.items()} == {q: sum(map(len, v)) for q, v in want.items()}
    assert got[0] == want[0][0]
    assert sorted(got[100]) == sorted(want[100][0] + want[100][1])
    assert ann.search(df.limit(0)).count() == 0
    one = ann.search(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert one.count() == 0


def test_far_vectors_and_small_tight_groups_get_whole_answers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 16))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    far = [0, 1000, 2000]
    x[far] *= 50
    for i in (500, 1500, 2500):  # groups of three, apart from all others
        x[i : i + 3] = x[i] * 20 + rng.normal(size=(3, 16)) * 1e-6
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=500).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute_search(rows, every=500)
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    for q in (*far, 500, 1500, 2500):
        assert [r.vec_id for r in got[q]] == [j for _, j in want[q][0]], q


def test_centroid_graph_finds_the_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16))
    g = ann.Graph(ann.halve(x, 64, rng))
    hits = sum(g.search(q)[0][1] == int(np.argmin(((g.c - q) ** 2).sum(axis=1))) for q in x[:200])
    assert hits >= 195
    sizes = np.bincount(ann.nearest(x, g.c), minlength=len(g.c))
    assert sizes.max() <= 6 * sizes.mean()
