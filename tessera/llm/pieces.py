"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts fall apart where a space mark follows another character, as no piece spans that. The distinct parts
are joined into one text; its suffixes are sorted by as many characters as the longest piece has; every piece is
found in them by binary search, which gives the range of all its occurrences. The occurrences are edges; sorted by
position they are relaxed from left to right. The model is a BPE one: a path of pieces is the encoding if and
only if each two neighbours are the encoding of their joint text (merges never cross a boundary that stays), so
an edge extends a position's one best path if its piece agrees with the path's last piece. Pairs are judged
once, by merging their joint text, and remembered. Characters outside the vocabulary become byte pieces.

Decoding joins the pieces' bytes, turns space marks into blanks and drops the leading one.

Nulls and empty texts: no ids, decoded to an empty text; a null doc_id is kept. The space mark itself can't be told
from a blank, as in the library. Repeated rows: each is encoded. Very long texts: whole; a part's cost is linear.
Memory is bounded by TEXT_CHARS of new text (or one text) at once and CACHE remembered parts and pairs. No rows: none. Extra
columns: ignored, whatever their names. No shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

MARK = "▁"
PARTS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
TEXT_CHARS, CACHE, LONG, SLOTS = 3_000_000, 400_000, 1_000, 1 << 21
ENCODED = "doc_id long, n_tokens long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean"


class Pieces:
    """A BPE model's pieces, and which pairs of them are stable."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(n)]
        special = [i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)]
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        if n > 0xFFFF:
            raise ValueError("more pieces than a pair's key holds")
        self.unknown = n  # stands for one character outside the vocabulary
        skip = set(special)
        self.ids = {p: i for i, p in enumerate(self.names) if i not in skip}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans a word's start")
        self.bytes = [p.replace(MARK, " ").encode() for p in self.names]
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        for i in special:
            if sp.is_control(i):
                self.bytes[i] = b""
        self.bytes_count = np.array([len(b) for b in self.bytes])
        self.bytes_start = np.cumsum(self.bytes_count) - self.bytes_count
        self.bytes_flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.stable: dict[int, bool] = {}
        self.asked, self.answer = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.forget()

    def forget(self) -> None:
        """Empties the list of encoded parts."""
        self.parts: dict[str, int] = {}
        self.start = self.count = np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def merged(self, text: str) -> list[str]:
        """text's symbols after all merges, best score first and leftmost among equals."""
        symbols = list(text)
        while True:
            best, at = -np.inf, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def agree(self, left: int, right: int) -> bool:
        """Whether [left, right] (right alone, if left is -1) is the encoding of their text."""
        key = (left + 1) << 16 | right
        known = self.stable.get(key)
        if known is None:
            known = True
            if right != self.unknown:
                b = self.names[right]
                if left in (-1, self.unknown):
                    known = self.merged(b) == [b]
                else:
                    a = self.names[left]
                    known = a + b not in self.score and self.merged(a + b) == [a, b]
            elif left not in (-1, self.unknown):
                known = self.agree(-1, left)
            if len(self.stable) > 5 * CACHE:
                self.stable.clear()
            self.stable[key] = known
        return known

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence of every piece in text, by a sorted list of its suffixes."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        letters, ranks = np.unique(points, return_inverse=True)
        rank = {chr(c): i + 1 for i, c in enumerate(letters.tolist())}
        kind = next(np.dtype(k) for k, most in (("u1", 254), (">u2", 65534), (">u4", 2**32 - 2)) if len(letters) <= most)
        width = self.longest * kind.itemsize
        padded = np.concatenate((ranks.ravel() + 1, np.zeros(self.longest, np.int64))).astype(kind)
        heads = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.longest)[: len(points)]).view(f"S{width}").ravel()
        order = np.argsort(heads, kind="stable")
        heads = heads[order]
        found = [(p, i) for p, i in self.ids.items() if all(c in rank for c in p)]
        keys = [np.array([rank[c] for c in p], dtype=kind).tobytes() for p, _ in found]
        low = np.searchsorted(heads, np.array(keys, dtype=f"S{width}"), "left")
        high = np.searchsorted(heads, np.array([k + b"\xff" * (width - len(k)) for k in keys], dtype=f"S{width}"), "right")
        times = high - low
        at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        start = order[at].astype(np.int32)
        piece = np.repeat(np.array([i for _, i in found], dtype=np.int32), times)
        end = start + np.repeat(np.array([len(p) for p, _ in found], dtype=np.int32), times)
        alone = np.ones(len(points), bool)
        alone[start[end == start + 1]] = False
        extra = np.flatnonzero(alone).astype(np.int32)  # characters that are no piece
        return np.concatenate((start, extra)), np.concatenate((end, extra + 1)), np.concatenate((piece, np.full(len(extra), self.unknown, np.int32)))

    def agreeing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """agree() of many pairs, through a table of the last answers."""
        key = (left + 1) << 16 | right
        slot = (key * 0x9E3779B1 >> 7) & (SLOTS - 1)
        out = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            told = np.array([self.agree((k >> 16) - 1, k & 0xFFFF) for k in pairs.tolist()])
            out[new] = told[back]
            self.asked[slot[new]], self.answer[slot[new]] = key[new], out[new]
        return out

    def relax(self, start, end, piece, head, size) -> tuple[np.ndarray, np.ndarray]:
        """The last piece of each position's path and where it starts; all parts advance together, a character a step."""
        last, back = np.full(size + 1, -2, np.int64), np.zeros(size + 1, np.int32)
        last[head] = -1
        offset = end - np.repeat(head, np.diff(head, append=size)).astype(np.int32)[start]
        short = offset <= LONG
        order = np.flatnonzero(short)[np.argsort(offset[short].astype(np.uint16), kind="stable")]
        s, e, p = start[order], end[order], piece[order]
        cuts = np.flatnonzero(np.diff(offset[order], prepend=-1, append=-1))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            before = last[s[i:j]]
            live = np.flatnonzero(before != -2) + i
            live = live[self.agreeing(before[live - i], p[live])]
            last[e[live]], back[e[live]] = p[live], s[live]
        order = np.flatnonzero(~short)
        for i in order[np.argsort(end[order], kind="stable")].tolist():  # parts of many characters go on alone
            if last[end[i]] == -2 and last[start[i]] != -2 and self.agree(int(last[start[i]]), int(piece[i])):
                last[end[i]], back[end[i]] = piece[i], start[i]
        return last, back

    def learn(self, parts: list[str]) -> None:
        """Encodes new parts, all in one text with a separator after each."""
        text = "\0".join(parts) + "\0"
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        head = np.cumsum(np.append(0, lengths + 1))[:-1]
        last, back = self.relax(*self.edges(text), head, len(text))
        on_path, at, stop = np.zeros(len(text) + 1, bool), head + lengths, head
        while len(at):
            on_path[at] = True
            at = back[at]
            more = at > stop
            at, stop = at[more], stop[more]
        ends = np.flatnonzero(on_path)
        ids, times = last[ends], np.ones(len(ends), np.int64)
        part = np.repeat(np.arange(len(parts)), lengths + 1)[ends - 1]
        raw = {i: text[back[ends[i]] : ends[i]].encode("utf-8", "surrogatepass") for i in np.flatnonzero(ids == self.unknown).tolist()}
        for i, b in raw.items():
            times[i] = len(b)
        ids = np.repeat(ids, times)
        first = np.cumsum(times) - times
        for i, b in raw.items():
            ids[first[i] : first[i] + len(b)] = [self.byte_ids[x] for x in b]
        count = np.bincount(part, weights=times, minlength=len(parts)).astype(np.int64)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))
        self.parts.update(zip(parts, range(len(self.parts), len(self.parts) + len(parts))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [PARTS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.parts) > CACHE:
            self.forget()
        new = sorted(set(chain.from_iterable(cut)) - self.parts.keys())
        if new:
            self.learn(new)
        which = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(cut)), np.int64)
        count = self.count[which]
        ids = gathered(self.flat, self.start[which], count)
        ends = np.concatenate(([0], np.cumsum(count)))[np.cumsum([len(c) for c in cut])]
        return np.split(ids, ends[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        return gathered(self.bytes_flat, self.bytes_start[ids], self.bytes_count[ids]).tobytes()[1:]


def gathered(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each, one after another."""
    return flat[np.arange(int(count.sum())) + np.repeat(start - (np.cumsum(count) - count), count)]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about TEXT_CHARS."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= TEXT_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, text, ids, decoded of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for some in groups([t or "" for t in batch.column(1).to_pylist()]):
                made = model.encode(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + len(some)], pa.int64()), pa.array(some), pa.array(made, pa.list_(pa.int32())),
                        pa.array([model.decode(m).decode("utf-8", "replace") for m in made]),
                    ],
                    names=["doc_id", "text", "ids", "decoded"],
                )
                at += len(some)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, text string, ids array<int>, decoded string")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per document what its ids and the text decoded from them are, without sending either on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path)
        names, kinds = ENCODED.replace(",", "").split()[::2], [pa.int64()] * 5 + [pa.bool_()]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            at = 0
            for some in groups([t or "" for t in batch.column(1).to_pylist()]):
                out = []
                for doc, t, made in zip(ids[at:], some, model.encode(some)):
                    back = model.decode(made)
                    out.append((doc, len(made), zlib.crc32(made.astype("<u4").tobytes()), len(back.decode()), zlib.crc32(back), back.decode() == t.replace(MARK, " ")))
                at += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, ENCODED)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
