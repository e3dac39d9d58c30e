"""Files of token ids against the tokenizer on whole texts, and codes against plain Huffman and package-merge."""

import heapq
import random
import uuid
import zlib

import numpy as np
import pytest
from conftest import DATA

from tessera.llm import huffman
from tessera.llm.common import shared_dir, table

ODD = [
    None, "", " \n\t ", "a\x0bb\x0cc\rd\x1ce\x1ff\x85g h　i", "<|endoftext|>x <|startoftext|> <|endof text|>", "It's we'll I'D can 't", "é ́x ̈", "가 ᆨ",
    "日本語 \U0001f468‍\U0001f469 \x00 ΣΑΣ ΟΔΟΣ İ ß", "x" * 5_000, "same row", "same row", "word " * 30_000, "''''s 'S '' s", "1234 12.5% a1b2",
    "END. end, End.. e.g. so?! so;: <|endoftext|>. <|ENDOFTEXT|> <|EndOfText|>, naïve. ÀÉÎ Œuvre, x.y. 5. é. é. z̈. a̓, " + "y" * 70 + ". ß. ſ K Å.",
]


def documents(spark):
    docs = list(enumerate(ODD, -5)) + [(None, "no id"), (None, None), (7, "again"), (2**62, "far"), (-(2**62), "near")]
    docs += [(r.doc_id + 100, r.text) for r in table(spark, DATA, "documents").collect()]
    random.Random(1).shuffle(docs)
    return docs


@pytest.mark.parametrize("file_ids,block,bits,run", [(huffman.FILE_IDS, huffman.BLOCK_IDS, huffman.MAX_BITS, huffman.RUN_BYTES), (3_000, 7, 13, 1), (1, 1, 24, 1_000)])
def test_files(spark, file_ids, block, bits, run):
    docs = documents(spark)
    t = huffman.tokenizer(None)
    df = spark.createDataFrame([(t, i, 1, "p", b"") for i, t in docs], "text string, doc_id long, place int, part string, ids binary").repartition(3)
    to = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    huffman.write_ids(df, to, file_ids=file_ids, block=block, most_bits=bits, run_bytes=run)
    ids = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in docs]
    got = sorted(huffman.read_ids(spark, to).collect(), key=lambda r: r.start)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=repr) == sorted(((i, len(x), crc(x)) for i, x in ids), key=repr)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    at = next(k for k, r in enumerate(got) if r.doc_id == 7 + 100)
    first = got[at].start
    whole = next(x for i, x in ids if i == 107) + next(x for i, x in ids if i == 108)
    assert huffman.read_slice(spark, to, first + 3, len(whole) - 5) == whole[3:-2]


def test_none(spark):
    to = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    huffman.write_ids(spark.createDataFrame([], "doc_id long, text string"), to)
    assert huffman.read_ids(spark, to).count() == 0


def test_words_are_enough(spark):
    import pyarrow as pa

    t, own = huffman.tokenizer(None), huffman.WordEncoder(None)
    texts = [x for _, x in documents(spark)]
    ids, n = own.encode(pa.array(texts, pa.string()))
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def merged(counts, most):
    """Package-merge with the symbols of each package written out."""
    leaves = sorted((c, (i,)) for i, c in enumerate(counts) if c)
    items = leaves
    for _ in range(most - 1):
        items = sorted(leaves + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(items[::2], items[1::2])], key=lambda x: x[0])
    out = [0] * len(counts)
    for _, own in items[: 2 * len(leaves) - 2]:
        for i in own:
            out[i] += 1
    return out


def plain_cost(counts):
    heap, cost = [c for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("seed", range(8))
def test_code_lengths(seed):
    r = random.Random(seed)
    counts = np.array([r.choice([0, 1, 2, 3, 10, 10, int(1.7**i)]) for i in range(r.randrange(2, 45))] + [1, 1])
    n = int((counts > 0).sum())
    for most in (max(1, (n - 1).bit_length()), 8, 24):
        most = max(most, (n - 1).bit_length())
        lengths = huffman.code_lengths(counts, most)
        assert lengths.max() <= most and ((lengths > 0) == (counts > 0)).all()
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1
        assert int((lengths * counts).sum()) == sum(a * b for a, b in zip(merged(counts.tolist(), most), counts.tolist()))
    assert int((huffman.code_lengths(counts, 60) * counts).sum()) == plain_cost(counts.tolist())


def test_canonical_codes():
    lengths = np.array([3, 0, 1, 3, 2], np.uint8)
    assert huffman.canonical(lengths).tolist() == [0b110, 0, 0b0, 0b111, 0b10]
    assert huffman.code_lengths(np.array([0, 5])).tolist() == [0, 1] and huffman.code_lengths(np.array([0, 0])).tolist() == [0, 0]


def test_a_cut_file_is_refused():
    with pytest.raises(ValueError):
        huffman.IdFile(huffman.MAGIC + b"\0" * 100)


def test_tails_are_cut_from_some_words_all_or_none():
    import pyarrow as pa

    from tessera.llm import huffman

    encode = huffman.WordEncoder(None)
    for texts in (["One, two. Three!?", "a", None, ""], ["plain words only"], ["End. end."], [None, ""]):
        ids, n = encode.encode(pa.array(texts, pa.string()))
        whole = [encode.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(whole, []) and n.tolist() == [len(w) for w in whole]


def test_plain_words_before_any_mark_skip_the_search_for_parts():
    """Every ASCII mark, alone and repeated, after letters of both kinds; only words that are not plain meet the whole tokenizer."""
    import pyarrow as pa

    met = []

    class Seen:
        def encode_batch_fast(self, texts, **kw):
            met.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    encode, whole = huffman.WordEncoder(None), huffman.tokenizer(None)
    encode.tokenizer = Seen()
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    texts = [f"{w}{m} {w}{m * 3} {w}{m}{n}" for w in ("END", "née", "ÀÉ", "réê", "it") for m in marks for n in ("#", "'", "<|", "|>")]
    odd = ["x<|endoftext|>", "<|endoftext|>...", "a<|startoftext|>b", "it's. 'll' é̀... 5$$$ A\u0338= É'S'", "ß### ÿ&&& ·· ª***", None, ""]
    for some in (texts, texts[:3] + odd, odd):
        ids, n = encode.encode(pa.array(some, pa.string()))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in some]
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == sum(want, [])
    encode.clear()
    met.clear()
    encode.encode(pa.array(["Plain réeux### words&&& end.%%% elles,*** née's"]))
    assert met and all(w in ("née's", *(m * 3 for m in "#&*"), ".%%%", ",***", "") for w in met), met


def test_ids_are_counted_over_slices():
    import pyarrow as pa

    rows = [np.array(r, "<u2").tobytes() for r in ([5, 1], [2], [], [5, 5, 7], [300])]
    column = pa.array(rows, pa.binary())
    for part in (column, column[1:4], column[2:3], column[:0]):
        (out,) = huffman.counted(2)(iter([pa.RecordBatch.from_arrays([part], names=["ids"])] * 2))
        want = np.bincount(np.frombuffer(b"".join(part.to_pylist()), "<u2"), minlength=301) * 2
        assert out.column(0).to_pylist() == np.flatnonzero(want).tolist() and out.column(1).to_pylist() == want[want > 0].tolist()
