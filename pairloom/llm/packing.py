"""Best-fit packing of tokenised documents into fixed-length sequences with a bounded number of open bins.

Each task packs the documents of its own partition: nothing is shuffled, memory is the open bins of one task, and a
lost task is redone with the same result. Open bins are found through a bitset keyed by free space: the lowest set bit
at or above a piece's length is the tightest bin. When no bin fits and the fixed number are open, the fullest closes.
Within an Arrow batch, which bounds the look-ahead, long pieces arrive first.

Defined cases: a null text is an empty document, one piece that holds only the separator; repeated rows are packed each
on its own, those of one length in the order of their rows; an empty table gives an empty result; other columns are neither read nor returned. A document longer than a
sequence is cut so that only its first piece is short; full pieces fill a sequence of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairloom.llm.bpe_count import byte_symbols
from pairloom.llm.common import id_text, sliced, texts, tidied

#: The split that byte-level pre-tokenizers apply before merging (a fixed value of the format).
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[tiktoken.Encoding, set[str]]:
    """The ids of a byte-level tokenizer file, by the faster of the two installed libraries (a test holds them equal).

    A vocabulary in which a token's id follows its merge's rank is what the ranks of the other library mean.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec["pre_tokenizer"], spec["model"]
    plain = before["type"] == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    plain = plain and model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("ignore_merges", "byte_fallback", "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if not plain or any(x >= y for x, y in zip(made, made[1:], strict=False)):
        raise ValueError("packing needs a plain byte-level tokenizer file whose merges come in the order of their ids")
    byte = {s: b for b, s in enumerate(byte_symbols())}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    return tiktoken.Encoding("packing", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens=special), set(special)


class OpenBins:
    """Bounded-space online best-fit over bins of one capacity."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece; bins are numbered in the order in which they open."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bins = self.by_free[free]
            at = bins.pop()
            if not bins:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            free, at = self.capacity, self.made
            self.made += 1
            if length < free and self.open >= self.most:
                self._close_fullest()
        if left := free - length:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free

    def _close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: the first takes what does not fill a sequence."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, open_bins: int = 4096, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit ids), sequence_id, offset of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, special = encoder(tokenizer)
        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        end, names = np.array([end_id], np.uint32), ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
        for batch in batches:
            ids: list[np.ndarray] = []
            for some in sliced(iter([batch]), 500):  # few texts at a time; of a whole batch only the ids are held
                ids += [np.concatenate([np.asarray(enc.encode_to_numpy(t, allowed_special=special), np.uint32), end]) if t else end for t in texts(some)]
            doc_ids = batch.column(0).to_pylist()
            pieces = [(length, k, p, s) for k, x in enumerate(ids) for p, (s, length) in enumerate(cuts(len(x), capacity))]
            pieces.sort(key=lambda x: -x[0])
            places = [bins.place(x[0]) for x in pieces]
            for at in range(0, len(pieces), 4096):
                n, k, p, s = zip(*pieces[at : at + 4096], strict=True)
                seq, off = zip(*places[at : at + 4096], strict=True)
                raw = [ids[i][b : b + m].astype("<u4").tobytes() for m, i, b in zip(n, k, s, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_ids[i] for i in k], pa.int64()), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array([base + x for x in seq], pa.int64()), pa.array(off, pa.int64())], names
                )

    return id_text(docs, id_col, text_col).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
