"""Token ids of documents in files of canonical, length-limited Huffman codes.

Documents are dealt to ranges of doc_id and sorted; their ids are written once to the shared folder with the place of each document
in its range. Ids are counted over all of them, package-merge gives the code lengths (MAX_BITS at most), and the codes follow from the lengths
alone. Each task turns runs of neighbouring documents into files of some FILE_IDS ids, which Spark's text writer commits as they are.

File (little endian): MAGIC; HEADER; zlib of the code lengths by id; doc_id, null flag and number of ids by document; a checkpoint for
each block of BLOCK_IDS ids, the bit at which it begins; the bits, first bit highest, in 32-bit words of big endian; END. A file holds all that its
decoding needs. Blocks are decoded apart: one table of 2^bits entries gives the id and the length for the next bits, and all
blocks of a file go forward together, an id each. read_slice() decodes only the blocks of the ids asked for.

Tokenising: words between blanks are encoded once a run of texts, as the tokenizer lets no id reach over a blank; tests compare with whole texts.

Nulls: a null text has the end id alone; a null doc_id comes first and stays null. Repeated rows: each is written; rows of one doc_id are ordered by the
hash of the text. Long texts: whole; a document never ends up in two files. No rows: no files, no rows. Extra columns: ignored, whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, released, shared_dir, stored, table
from tessera.llm.infilling import runs

END_ID = 2
MAX_BITS, BLOCK_IDS, FILE_IDS = 16, 256, 2_000_000
RUN_BYTES, PACK_IDS = 4_000_000, 1 << 18
#: Words whose ids a task keeps; longer ones are not kept. When full, the store starts anew.
CACHE, CACHED_BYTES = 400_000, 64
#: Letters that the tokenizer joins to one word, alone or beside each other, and marks (all of ASCII) that end such a word; words encoded as one string.
PLAIN, TAIL, JOINED = "a-zA-ZÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~", 64
MAGIC, END = b"TESSHUF1", "\nTESSEND\n"
#: First id's place in the corpus, documents, ids, ids a block, longest code, symbols, bytes of the packed lengths, bits.
HEADER = "<QQQIIIQQ"
TOKENISED = "part int, doc_id long, place long, n_tokens long, ids binary"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words `which`, one after the other, and their numbers of ids."""
    own = size[which]
    end = np.cumsum(own)
    return flat[np.repeat(first[which] - (end - own), own) + np.arange(end[-1] if len(end) else 0)], own


class WordEncoder:
    """Ids of whole texts from those of their distinct stems and tails.

    A tail is the marks after a word's last plain letter, where the tokenizer always parts; A-Z count as a-z, as it lowers
    them. Plain stems are encoded many to a string: each is one word to the tokenizer, so its ids end at the one that ends a word. They
    need no composing of letters and no search for the places to part, so they go through the tokenizer without these.
    """

    def __init__(self, path: str | None):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = tokenizer(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.normalizer = normalizers.Lowercase()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self.ends = np.zeros(size, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64)

    def batch(self, texts: list[str], plain: bool = False) -> list[np.ndarray]:
        made = (self.plain if plain else self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in made]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = pc.match_substring_regex(pa.array(words, pa.string()), f"^[{PLAIN}]{{1,{CACHED_BYTES}}}$").to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        some = [words[i] for i in order[: plain.sum()]]
        ids = np.concatenate([np.zeros(0, self.dtype), *self.batch([" ".join(some[i : i + JOINED]) for i in range(0, len(some), JOINED)], plain=True)])
        size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(size) != len(some) or size.sum() != len(ids):  # not a vocabulary of this kind
            size, ids, order = np.zeros(0, np.int64), ids[:0], np.arange(len(words))
        rest = self.batch([words[i] for i in order[len(size) :]])
        size = np.concatenate([size, np.fromiter(map(len, rest), np.int64, len(rest))])
        flat = np.concatenate([ids, *rest])
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return gathered(flat, np.cumsum(size) - size, size, back)

    def slots(self, words: list[str]) -> np.ndarray:
        """Places of the words in size; those that are new are encoded."""
        if len(self.known) + len(words) > CACHE or len(self.flat) > 8 * CACHE:
            self.clear()
        out = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        out[new] = len(self.size) + np.arange(len(new))
        missing = [words[i] for i in new]
        ids, size = self.encode_words(missing)
        self.known.update((w, i) for w, i in zip(missing, out[new].tolist()) if len(w) <= CACHED_BYTES)
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and each text's number of ids."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        whole = words.dictionary
        special = pc.match_substring(whole, "<|")  # special tokens have a case, and marks of their own
        low = pc.if_else(special, whole, pc.ascii_lower(whole))
        stem = pc.if_else(special, whole, pc.replace_substring_regex(low, f"([{PLAIN}])[{TAIL}]+$", r"\1"))
        cut = pc.not_equal(stem, low)
        tail = pc.replace_with_mask(pa.repeat(pa.scalar("", low.type), len(low)), cut, pc.replace_substring_regex(low.filter(cut), f"^(?s:.*)[{PLAIN}]([{TAIL}]+)$", r"\1"))
        parts = pa.concat_arrays([stem, tail]).dictionary_encode()
        slot = self.slots(parts.dictionary.to_numpy(zero_copy_only=False).tolist())[parts.indices.to_numpy()]  # faster than to_pylist()
        first = np.cumsum(self.size) - self.size
        flat, size = gathered(self.flat, first, self.size, slot.reshape(2, -1).T.ravel())  # stem, tail, stem, tail
        size = size.reshape(-1, 2).sum(axis=1)
        ids, own = gathered(flat, np.cumsum(size) - size, size, words.indices.to_numpy())
        return ids, np.diff(np.append(0, np.cumsum(own))[split.offsets.to_numpy() - split.offsets[0].as_py()])


@lru_cache(1)
def encoder(path: str | None) -> WordEncoder:
    """One for all tasks of a process, with the words it knows."""
    return WordEncoder(path)


def tokenised_rows(path: str | None, end_id: int, most: int):
    """For mapInArrow: each document's ids with the end id, and its place among the ids of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in runs(batch, "text", most):
                texts = rows.column("text").combine_chunks()
                ids, n = encode.encode(texts)
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                n = n + 1
                ends = np.cumsum(n)
                width = ids.itemsize
                if width * len(ids) < 2**31:
                    own = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, ends * width).astype(np.int32)), pa.py_buffer(ids)])
                else:
                    own = pa.array([ids[a:b].tobytes() for a, b in zip(ends - n, ends)], pa.large_binary()).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part), pa.int32()), rows.column("doc_id").combine_chunks(), pa.array(place + ends - n), pa.array(n), own],
                    names=["part", "doc_id", "place", "n_tokens", "ids"],
                )
                place += int(ends[-1])

    return run


def counted(width: int):
    """For mapInArrow: a task's count of each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            _, ends, held = batch.column(0).buffers()  # the ids of all rows lie end to end
            ends = np.frombuffer(ends, np.int32)[batch.column(0).offset :][: len(batch) + 1]
            own = np.bincount(np.frombuffer(held or b"", np.uint8)[ends[0] : ends[-1]].view(f"<u{width}")) if len(batch) else total[:0]
            if len(own) > len(total):
                total = np.append(total, np.zeros(len(own) - len(total), np.int64))
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with none over `most` bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    most = max(most, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    from_leaf: list[np.ndarray] = []  # a level's items by weight: is it a leaf, or a package of two items of the level below
    items, is_leaf = leaves, np.ones(len(leaves), bool)
    for _ in range(most):
        from_leaf.append(is_leaf)
        packages = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        items, is_leaf = both[rank], rank < len(leaves)
    take = 2 * (len(leaves) - 1)
    for is_leaf in reversed(from_leaf):
        own = int(np.count_nonzero(is_leaf[:take]))
        out[order[:own]] += 1
        take = 2 * (take - own)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by id: ordered by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        steps = np.left_shift(np.int64(1), size[-1] - size)  # in units of the longest code
        codes[order] = np.right_shift(np.cumsum(steps) - steps, size[-1] - size).astype(np.uint64)
    return codes


def bits_of(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """32-bit words, checkpoints and number of bits."""
    total = int(lengths[ids].sum(dtype=np.int64))
    words, checkpoints, at = np.zeros(total // 32 + 2, np.uint64), [], 0
    step = max(block, PACK_IDS // block * block)
    sizes = lengths.astype(np.int64)
    high = codes << ((64 - sizes) & 63).astype(np.uint64)  # a code's bits are the first
    for k in range(0, len(ids), step):
        some = ids[k : k + step]
        size = sizes[some]
        end = at + np.cumsum(size)
        begin = end - size
        checkpoints.append(begin[::block])
        value = high[some] >> (begin & 31).view(np.uint64)
        word = begin >> 5
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))  # codes are shorter than words: each word in between has one
        word = word[first]  # each once
        words[word] += np.add.reduceat(value >> np.uint64(32), first)
        words[word + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        at = int(end[-1])
    return words.astype(">u4"), np.concatenate(checkpoints) if checkpoints else np.zeros(0, np.int64), total


def file_of(start: int, docs: list[tuple[int | None, int]], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, packed: bytes, block: int) -> bytes:
    words, checkpoints, bits = bits_of(ids, lengths, codes, block)
    return b"".join([
        MAGIC, struct.pack(HEADER, start, len(docs), len(ids), block, int(lengths.max(initial=1)), len(lengths), len(packed), bits), packed,
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is None for d, _ in docs], np.uint8).tobytes(), np.array([n for _, n in docs], "<u8").tobytes(),
        checkpoints.astype("<u8").tobytes(), words.tobytes(),
    ])


def files_of(base: dict[int, int], lengths: np.ndarray, width: int, file_ids: int, block: int):
    """For mapInArrow: a file for each run of documents that follow each other. base: ids before each partition."""
    codes, packed = canonical(lengths), zlib.compress(lengths.tobytes(), 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int | None, int]] = []
        held: list[np.ndarray] = []
        start = size = 0

        def whole() -> pa.RecordBatch:
            content = file_of(start, docs, np.concatenate(held), lengths, codes, packed, block)
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for part, doc, place, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                at = base[part] + place
                if docs and (at != start + size or size >= file_ids):
                    yield whole()
                    docs, held, size = [], [], 0
                if not docs:
                    start = at
                docs.append((doc, n))
                held.append(np.frombuffer(ids.as_buffer(), f"<u{width}"))
                size += n
        if docs:
            yield whole()

    return run


class IdFile:
    """A file's parts; ids are decoded when asked for."""

    def __init__(self, content: bytes):
        if content[: len(MAGIC)] != MAGIC or not content.endswith(END.encode()):
            raise ValueError("not a file of token ids, or cut off")
        self.start, n_docs, self.n_ids, self.block, self.bits, n_symbols, packed, total = struct.unpack_from(HEADER, content, len(MAGIC))
        at = len(MAGIC) + struct.calcsize(HEADER)
        self.lengths = np.frombuffer(zlib.decompress(content[at : at + packed]), np.uint8, n_symbols)
        at += packed

        def column(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(content, kind, n, at)
            at += out.nbytes
            return out

        self.doc_id, self.null, self.n_tokens = column("<i8", n_docs), column("u1", n_docs).astype(bool), column("<u8", n_docs).astype(np.int64)
        self.checkpoints = column("<u8", -(-self.n_ids // self.block)).astype(np.int64)
        self.words = column(">u4", total // 32 + 2)
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The id and the code length for each value of the next bits."""
        if self.table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            each = np.left_shift(1, self.bits - self.lengths[order].astype(np.int64))
            ids, size = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int64)
            full = int(each.sum())
            ids[:full], size[:full] = np.repeat(order, each), np.repeat(self.lengths[order], each)
            self.table = ids, size
        return self.table

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last (not included), all decoded side by side."""
        ids, size = self.tables()
        at = self.checkpoints[first:last]
        low = int(at[0]) >> 5
        high = (int(self.checkpoints[last]) if last < len(self.checkpoints) else 32 * len(self.words)) // 32 + 2
        pad = self.block * self.bits // 32 + 3  # the last block may be short
        words = np.append(self.words[low:high].astype(np.uint64), np.zeros(pad, np.uint64))
        pairs = words[:-1] << np.uint64(32) | words[1:]
        at = at - 32 * low
        out = np.empty((self.block, len(at)), np.uint32)
        right, mask = 64 - self.bits, np.uint64((1 << self.bits) - 1)
        for step in range(self.block):
            seen = (pairs[at >> 5] >> (right - (at & 31)).astype(np.uint64)) & mask
            out[step] = ids[seen]
            at = np.minimum(at + size[seen], 32 * (len(pairs) - 1))
        return out.T.ravel()[: self.n_ids - first * self.block]

    def ids(self, first: int = 0, n: int | None = None) -> np.ndarray:
        """n ids from the first-th on, of this file."""
        last = self.n_ids if n is None else min(self.n_ids, first + n)
        if last <= first:
            return np.zeros(0, np.uint32)
        block = first // self.block
        return self.blocks(block, -(-last // self.block))[first - block * self.block : last - block * self.block]


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the documents of files."""
    for batch in batches:
        for content in batch.column(0):
            content = content.as_py()
            if not content:
                continue
            f = IdFile(content)
            ends = np.cumsum(f.n_tokens)
            starts = ends - f.n_tokens
            raw = memoryview(f.ids().astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.doc_id, mask=f.null), pa.array(f.start + starts), pa.array(f.n_tokens), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_ids(
    docs: DataFrame, to: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, most_bits: int = MAX_BITS,
    file_ids: int = FILE_IDS, block: int = BLOCK_IDS, run_bytes: int = RUN_BYTES,
) -> None:
    """Writes the ids of all documents, by doc_id, as files into the folder `to`."""
    spark = docs.sparkSession
    with_width = tokenizer(path)
    width = 4 if with_width.get_vocab_size() > 1 << 16 else 2
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # rows of one doc_id have keys of their own, so that they can lie in several ranges
    keyed = slim.withColumns({"hash": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(partitions(spark), "doc_id", "hash", "nth").sortWithinPartitions("doc_id", "hash", "nth")
    tokens = stored(ranged.select("doc_id", "text").mapInArrow(tokenised_rows(path, end_id, run_bytes), TOKENISED), "tokens")
    released(spark)
    counts = tokens.select("ids").mapInArrow(counted(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # the vocabulary at most
    total = np.zeros(max((r.id for r in counts), default=-1) + 1, np.int64)
    for r in counts:
        total[r.id] = r.n
    base, before = {}, 0
    for r in tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row for each shuffle partition
        base[r.part] = before
        before += r.n
    files = tokens.mapInArrow(files_of(base, code_lengths(total, most_bits), width, file_ids, block), "content binary")
    files.select(F.col("content").cast("string")).write.option("lineSep", END).option("maxRecordsPerFile", 1).option("compression", "none").text(to)
    released(spark, tokens)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder of files, decoded; see DECODED."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decoded, DECODED)


def read_slice(spark: SparkSession, path: str, start: int, n: int) -> list[int]:
    """n ids of the corpus from its start-th on; of a file only the blocks that hold some are decoded."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                f = IdFile(content.as_py()) if content.as_py() else None
                first = max(start, f.start) if f else 0
                if f and (own := min(start + n, f.start + f.n_ids) - first) > 0:
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([f.ids(first - f.start, own).tolist()], pa.list_(pa.int64()))], names=["at", "ids"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(some, "at long, ids array<long>")
    return [i for r in sorted(found.collect()) for i in r.ids]


def op11_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/tessera-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), to)
    return read_ids(spark, to)
