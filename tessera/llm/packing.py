"""Packing of tokenised documents into fixed windows by sum-of-squares online bin packing.

A document is its token ids and an end id. Windows that it fills alone are cut off its front; what remains is
placed, document after document, into the fill level (or a new window) for which the sum over all levels of the
squared number of partly filled windows grows least, as kept in one array by level. Ties go to the fullest level.
When a packer's documents have ended, its emptiest open windows are cut up to fill the fullest ones, so that
at most one window of a packer is padded.

A packer takes at most DOCS_PER_PACKER documents, dealt round robin, so its memory is bounded and a hot source is
spread evenly; it orders them by (doc_id, start, ids), so that a packer run again after a loss packs alike.

Nulls: a null text has no ids (its end id is packed), a null doc_id is kept. Repeated rows: each is packed.
Long texts: cut into windows. No rows: no pieces. Extra columns: ignored, whatever their names.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

WINDOW, END_ID = 1024, 0
#: Fixed value: the tokenizer's special token; its id follows the vocabulary.
SPECIAL = "<|endoftext|>"
DOCS_PER_PACKER = 32_768
CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoder(path: str | None = None):
    """The byte-level BPE; the ranks file holds the vocabulary of byte_bpe_50k.json and gives the same ids (tested). Like
    that file's tokenizer it reads the special token's string in a text as that token."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_documents(path: str | None = None, window: int = WINDOW):
    """For mapInArrow: each document's full windows, and the rest with its ids (16 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(bpe.encode_to_numpy(text.as_py() or "", allowed_special="all"), np.uint32(END_ID))
                n = len(ids)
                out += [(doc, s, window, crc(ids[s : s + window]), n, None) for s in range(0, n - window + 1, window)]
                if n % window:
                    s = n - n % window
                    out.append((doc, s, n - s, 0, n, ids[s:].astype("<u2").tobytes()))
            columns = zip(*out) if out else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=CUT.replace(",", "").split()[::2])

    return run


class SumOfSquares:
    """Open windows by fill level, and the rule that picks a level."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)  # partly filled windows by level; 0 and window stay 0
        self.at: list[list[list]] = [[] for _ in range(window + 1)]
        self.closed: list[list] = []

    def level(self, size: int) -> int:
        """The level to leave; 0 opens a window. N(h) falls and N(h + size) grows by one."""
        last = self.window - size
        leave = np.where(self.count[1 : last + 1] > 0, 1 - 2 * self.count[1 : last + 1], np.iinfo(np.int64).max // 2)
        cost = np.concatenate(([0], leave)) + np.where(np.arange(size, self.window + 1) < self.window, 2 * self.count[size:] + 1, 0)
        return last - int(np.argmin(cost[::-1]))

    def place(self, piece, size: int) -> None:
        h = self.level(size)
        held = self.at[h].pop() if h else []
        self.count[h] -= h > 0
        held.append(piece)
        if h + size == self.window:
            self.closed.append(held)
        else:
            self.at[h + size].append(held)
            self.count[h + size] += 1


def pour(open_windows: list[list], window: int) -> list[list]:
    """Open windows, fullest first, filled with pieces of the emptiest, which are cut where need be."""
    stack = sorted(open_windows, key=lambda w: -sum(len(p[2]) for p in w))
    done: list[list] = []
    i, j = 0, len(stack) - 1
    while i <= j:
        held = stack[i]
        room = window - sum(len(p[2]) for p in held)
        while room and j > i:
            doc, start, ids, n = stack[j].pop()
            if len(ids) > room:
                stack[j].append((doc, start, ids[: len(ids) - room], n))
                start, ids = start + len(ids) - room, ids[len(ids) - room :]
            held.append((doc, start, ids, n))
            room -= len(ids)
            if not stack[j]:
                j -= 1
        done.append(held)
        i += 1
    return done


def pack(window: int = WINDOW):
    """For mapInArrow: pieces with their sequences; a packer's numbers follow its partition's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        names = PIECE.replace(",", "").split()[::2]
        packer = SumOfSquares(window)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 7)], names=names)

        for batch in batches:
            full = []
            for doc, start, length, code, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if ids is None:
                    full.append((doc, start, length, code, n, sequence, 0))
                    sequence += 1
                else:
                    packer.place((doc, start, np.frombuffer(ids, "<u2"), n), length)
            yield rows(full)
        for held in packer.closed + pour([w for level in packer.at for w in level], window):
            out, offset = [], 0
            for doc, start, ids, n in held:
                out.append((doc, start, len(ids), crc(ids), n, sequence, offset))
                offset += len(ids)
            sequence += 1
            yield rows(out)

    return run


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """The pieces of all documents; see PIECE."""
    packers = max(1, math.ceil(docs.count() / DOCS_PER_PACKER))
    cut = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut_documents(path, window), CUT)
    dealt = cut.repartition(packers).sortWithinPartitions("doc_id", "start", "ids")
    return dealt.mapInArrow(pack(window), PIECE)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
