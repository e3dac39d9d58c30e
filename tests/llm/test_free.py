"""The other operators against brute force: packing, neighbours, SimHash, substrings, pieces, pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DATA

import corpus_pipeline
from tessera.llm import nearest, packing, pieces, simhash, substrings, suffixes
from tessera.llm.common import table

SCHEMA = "doc_id long, text string"


def odd_documents(seed: int, n: int = 90) -> list[tuple]:
    """Shared passages, near copies, runs, copies, nulls, empty and long texts, repeated rows and ids."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "x" * 30]
    base = [r.choice(words) for _ in range(400)]
    out: list[tuple] = []
    for i in range(n):
        kind = r.random()
        if kind < 0.3:
            a = r.randrange(300)
            t = base[a : a + r.randrange(20, 90)] + [r.choice(words) for _ in range(r.randrange(30))]
        elif kind < 0.45:
            t = ["a"] * r.randrange(150)
        elif kind < 0.7:
            t = base[:200]
            t[r.randrange(200)] = "X"
        elif kind < 0.8:
            t = base[100:180]
        else:
            t = [r.choice(words) for _ in range(r.randrange(5, 60))] + base[50 : 50 + r.randrange(60)]
        out.append((i, r.choice([" ", "\n", " \t"]).join(t)))
    return [*out, (200, None), (201, ""), (202, "x" * 500), (203, "x" * 199), (204, "  \n\t "), (205, "é" * 300), (206, "ab" * 4000), (None, "just this"), (207, "same row"), (207, "same row"), (208, None)]


def covered(parts, length: int, seen: Counter) -> np.ndarray:
    gone = np.zeros(len(parts), bool)
    for p in range(len(parts) - length + 1):
        if seen[parts[p : p + length]] > 1:
            gone[p : p + length] = True
    return gone


@pytest.mark.parametrize("crowd", [50_000, 1])
def test_substrings(spark, crowd):
    docs = odd_documents(crowd)
    split = [(i, tuple((t or "").encode().split())) for i, t in docs]
    seen = Counter(w[p : p + 35] for _, w in split for p in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = covered(w, 35, seen)
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], SCHEMA + ", copies int, own string")
    got = [tuple(r) for r in substrings.dedup_words(df, crowd=crowd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("crowd,n", [(50_000, 90), (6, 60)])
def test_suffixes(spark, crowd, n):
    docs = odd_documents(crowd + 1, n)
    raw = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(w[p : p + 200] for _, w in raw for p in range(len(w) - 199))
    want, left = [], {}
    for i, w in raw:
        gone = covered(w, 200, seen)
        kept = np.frombuffer(w, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(w), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
        left[i] = kept.decode("utf-8", "ignore")
    df = spark.createDataFrame([(i, t, 1, "c", "d") for i, t in docs], SCHEMA + ", n_chars long, own string, `a.b` string")
    got = [tuple(r) for r in suffixes.dedup_bytes(df, crowd=crowd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    cut = suffixes.cut_repeats(df, crowd=crowd)
    assert cut.columns == df.columns
    assert all((r.text, r.n_chars, r.own, r["a.b"]) == (left[r.doc_id], len(left[r.doc_id]), "c", "d") for r in cut.collect())


def test_parts_of_a_context():
    """Equal windows get equal keys and floors, whatever stands around them; each window is in one part."""
    r = np.random.default_rng(3)
    base = r.integers(97, 101, 600).astype(np.uint8)
    at = suffixes.triggers(suffixes.Hashes(suffixes._LETTER[base]))
    t = int(at[len(at) // 2])
    floor, seen = 0, {}
    for low, high in ((t - 150, t + 250), (t - 190, t + 210), (t - 100, t + 280)):
        keys, floors, first, last = suffixes.parted(base[low:high], t - low, floor)
        assert first[0] == 0 and last[-1] == high - low - suffixes.LENGTH and (first[1:] == last[:-1] + 1).all()
        for k, f, a, z in zip(keys.tolist(), floors.tolist(), first.tolist(), last.tolist()):
            for w in range(a, z + 1):
                assert seen.setdefault(low + w, (k, f)) == (k, f)
    assert len({k for k, _ in seen.values()}) > 1


def test_only_contexts_that_may_share_a_window_are_ordered(monkeypatch):
    """A phrase in 500 unlike texts costs no suffix array; windows that are shared are found, wherever their anchor stands."""
    ordered, real = [], suffixes.SuffixArray.__init__
    monkeypatch.setattr(suffixes.SuffixArray, "__init__", lambda self, values, *a: (ordered.append(len(values)), real(self, values, *a))[1])
    r = np.random.default_rng(5)
    noise = lambda n: r.integers(97, 123, n).astype(np.uint8).tobytes()
    phrase = noise(20)
    before, after = [noise(180) for _ in range(500)], [phrase + noise(180) for _ in range(500)]
    assert not any(len(h) for h in suffixes.shared_windows(np.zeros(500, np.int64), before, after))
    assert sum(ordered) < 1_000
    for low in range(0, 181):  # two more share just one window, with `low` bytes before the anchor
        b, a = noise(low), phrase + noise(180 - low)
        pair = [b + noise(180 - low), b + b"A" + noise(179 - low)] if low < 180 else [b, b], [a + noise(low), a + b"A" + noise(low - 1)] if low else [a, a]
        if low < 180:
            pair[0][0] = b + b"B" + pair[0][0][low + 1 :]
        if low:
            pair[1][0] = a + b"B" + pair[1][0][len(a) + 1 :]
        hits = suffixes.shared_windows(np.zeros(502, np.int64), before + pair[0], after + pair[1])
        assert [h.tolist() for h in hits] == [[]] * 500 + [[low]] * 2


def test_anchors_of_texts_laid_end_to_end():
    r = np.random.default_rng(6)
    texts = [r.integers(97, 101, n).astype(np.uint8) for n in (0, 7, 199, 200, 201, 3_000, 0, 250, 1_000)] + [np.full(2_000, 97, np.uint8), np.zeros(0, np.uint8)]
    seed, context, place, of = suffixes.parsed(texts)
    got = sorted(zip(of.tolist(), seed.tolist(), context.tolist(), place.tolist()))
    assert got == sorted((i, *(c.item() for c in row)) for i, t in enumerate(texts) for row in zip(*suffixes.parsed([t])[:3]))
    for i, t in enumerate(texts):
        windows = [w for _, _, _, p in (g for g in got if g[0] == i) for w in range((p >> 16) - (p >> 8 & 255), (p >> 16) - (p >> 8 & 255) + (p & 255) + 1)]
        assert sorted(windows) == list(range(len(t) - 199))


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA + ", n_chars long")
    assert substrings.dedup_words(none).count() == suffixes.dedup_bytes(none).count() == 0
    assert packing.pack_documents(none).count() == simhash.near_duplicates(none).count() == simhash.without_copies(none).count() == 0
    assert pieces.digests(none).count() == 0
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(r.doc_id, r.text) for r in table(spark, DATA, "documents").collect()] + [(-1, None), (-2, ""), (-3, "x <|endoftext|> a<|endoftext|><|endoftext|"), (-4, "word " * 30_000)]
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x in docs}
    rows = packing.pack_documents(spark.createDataFrame(docs, SCHEMA)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for group, size in [(by_doc[i], len(v)) for i, v in ids.items()] + [(s, None) for s in by_seq.values()]:
        at = 0
        for start, length in sorted(group):
            assert start == at
            at += length
        assert at == size if size else at <= packing.WINDOW
    assert sum(sum(n for _, n in s) < packing.WINDOW for s in by_seq.values()) <= 1


def test_sum_of_squares_rule():
    r, p = random.Random(5), packing.SumOfSquares(32)
    for _ in range(400):
        size = r.randrange(1, 32)
        n = p.count.copy()

        def cost(h, n=n, size=size):
            after = n.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 32
            return int((after**2).sum())

        best = min(cost(h) for h in range(32 - size + 1) if h == 0 or n[h])
        assert cost(p.level(size)) == best
        p.place(None, size)


def test_repeated_rows_are_packed_each(spark):
    rows = packing.pack_documents(spark.createDataFrame([(1, "same")] * 5 + [(None, "x")], SCHEMA)).collect()
    assert Counter(r.doc_id for r in rows)[1] == 5 and len(rows) == 6


def test_nearest_ties_and_invalid(spark):
    g = np.random.default_rng(1)
    v = {i: [float(x) for x in g.integers(-3, 4, 6)] for i in range(0, 130)}
    for i in range(30, 100):
        v[i] = v[20]  # many equal vectors: ties go to smaller ids
    bad = {200: None, 220: [0.0] * 6, 240: [float("nan")] + [1.0] * 5, 260: [None] + [1.0] * 5, 280: [1.0, 2.0], 300: [float("inf")] * 6}
    rows = [(i, x, 7) for i, x in {**v, **bad}.items()] + [(40, v[40], 7), (None, v[0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: x for i, x in v.items() if any(x)}
    for q in [i for i in good if i % 20 == 0]:
        want = sorted(((-sum(a * b for a, b in zip(good[q], x)), i) for i, x in good.items() if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in want]
    assert set(got) == {i for i in good if i % 20 == 0}  # 280 has no candidate of its length


def test_nearest_bounds_hold():
    g = np.random.default_rng(2)
    q, x = g.normal(size=(20, 64)) * 10.0 ** g.integers(-3, 4, (20, 1)), g.normal(size=(300, 64))
    near, off = nearest.tile_bounds(q, x)
    assert (np.abs(near - q @ x.T) <= off).all()


def brute_print(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    docs = odd_documents(9) + [(300, "ÀB Cd e f g"), (301, "Àb cd E F G"), (302, "one two")]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "k") for i, t in docs], SCHEMA + ", fp string")).collect()
    prints = {(i, t): brute_print(t) for i, t in docs}
    up = {p: p for p in prints.values()}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for a in list(up):
        for b in list(up):
            if (a ^ b).bit_count() <= 4:
                up[find(a)] = find(b)
    least: dict[int, int] = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[find(p)] = min(least.get(find(p), i), i)
    want = sorted((repr(i), f"{prints[i, t]:016x}", repr(least.get(find(prints[i, t])))) for i, t in docs)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want


@pytest.mark.parametrize("n", [10, 1_000, 200_000, 10**10])
def test_masks_miss_no_pair(n):
    g, m = random.Random(n), simhash.masks(n, 4)
    assert len(m) <= 126 and max(x.bit_count() for x in m) >= np.log2(n) - 1
    for _ in range(300):
        flips = sum(1 << b for b in g.sample(range(64), 4))
        assert any(not flips & x for x in m)


def test_buckets_lose_no_link():
    g = np.random.default_rng(3)
    for n in (1, 2, 70, 250):
        base = g.integers(0, 2**63, 3, dtype=np.int64).view(np.uint64)
        flips = [np.bitwise_or.reduce(np.uint64(1) << g.integers(0, 64, g.integers(0, 7)).astype(np.uint64), initial=np.uint64(0)) for _ in range(n)]
        x = np.unique(np.array([base[g.integers(3)] ^ f for f in flips], dtype=np.uint64))
        want, got = simhash.Forest(len(x)), simhash.Forest(len(x))
        for i in range(len(x)):
            for j in range(i):
                if np.bitwise_count(x[i] ^ x[j]) <= 4:
                    want.join(i, j)
        for a, b in simhash.large_bucket(x, 4):
            assert np.bitwise_count(x[a] ^ x[b]) <= 4
            got.join(a, b)
        assert [want.find(i) for i in range(len(x))] == [got.find(i) for i in range(len(x))]


def test_near_copies_leave_one(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abcdefghij") + str(r.randrange(300)) for _ in range(120)) for _ in range(30)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    near = [(100 + i, t.replace(t.split()[60], "changed", 1), "s") for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame([*rows, *near, *rows[:5], (500, texts[7], "s"), (None, texts[8], "s"), (600, None, "s"), (601, "", "s")], SCHEMA + ", source string")
    out = simhash.without_copies(df)
    assert out.columns == df.columns
    assert sorted(x.doc_id for x in out.collect()) == [*range(30), 600]


def test_pieces_equal_the_library():
    import public_tokenizers
    import sentencepiece

    sp, m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces.Pieces()
    texts = ["", "  a  b\n\tc ﬁ Ⅷ é 　x", "▁a", "hello <s> </s> world", " ", "      ", "a\0b", "x" * 3000, "日本語テキスト 中文 梦", "\U0001f600 \U0001f600\U0001f600", "   def f(x):\n        return 12345 + x   ", "ab  " * 50, "<0x41> <unk>", " " * 37 + "y", "the quick brown fox " * 30]
    texts += [t or "" for _, t in odd_documents(6)]
    for t, ids in zip(texts, m.encode(texts)):
        assert ids.tolist() == sp.encode(t)
        assert m.decode(ids).decode() == t.replace(pieces.MARK, " ")


def test_piece_documents(spark):
    got = {r.doc_id: (r.n_tokens, r.round_trip) for r in pieces.digests(spark.createDataFrame([(1, None), (None, "a b"), (2, "")], SCHEMA)).collect()}
    assert got == {1: (0, True), None: (2, True), 2: (0, True)}


def test_pipeline(spark, tmp_path):
    docs, kept = table(spark, DATA, "documents"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        if i < 3:
            assert out.columns == docs.columns
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            assert len(ids) == len(set(ids))
            kept.append(set(ids))
        docs = out
    assert kept[2] == kept[1] < kept[0]
    clean = {r.doc_id for r in table(spark, DATA, "labels").where("quality = 1").join(table(spark, DATA, "documents"), "doc_id").where("size(split(text, ' ')) > 12").collect()}
    assert clean <= kept[0] or len(clean - kept[0]) <= 0.02 * len(clean)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == kept[2]
    assert docs.count() == corpus_pipeline.run(spark, DATA).count()
