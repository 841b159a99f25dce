"""Token counts by byte-pair merging with a heap over a linked list of symbols.

The lowest-rank adjacent pair is merged first, again and again; a word's count is its initial symbols minus its
merges, and no identifier is ever built. Words repeat, so each process keeps a bounded table of counts by word.

Defined cases: null text counts as empty (0 bytes, 0 tokens); white space gives no token; repeated rows are counted
one by one; an empty table gives an empty result; other columns of the input are neither read nor returned. Special
strings inside a text count one token each, as the tokenizer's default has it. Very long texts are counted whole, word by word. Files
with other normalisers, splits or merge rules are refused.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import id_text, map_batches, texts

_CACHED_WORDS, _CACHED_LENGTH = 1 << 20, 48


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    table = {b: chr(b) for b in shown}
    return [table[b] if b in table else chr(next(hidden)) for b in range(256)]


def refuse_unlike(spec: dict) -> None:
    """An error for a tokenizer file that asks for steps which counting by merges does not take."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    steps = (spec.get("normalizer") or {"type": "Sequence", "normalizers": []}).get("normalizers", [None])
    known = all(n and (n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}) for n in steps)
    parts = before.get("pretokenizers", []) if before.get("type") == "Sequence" else []
    split = [p["type"] for p in parts] == ["Split", "ByteLevel"] and "Regex" in parts[0]["pattern"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    split = split and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True)
    merges = model.get("type", "BPE") == "BPE" and not any(model.get(x) for x in ("ignore_merges", "byte_fallback", "dropout", "unk_token", "continuing_subword_prefix"))
    added = not any(t.get(x) for t in spec.get("added_tokens", []) for x in ("lstrip", "rstrip", "single_word", "normalized"))
    if not (known and split and merges and added):
        raise ValueError("token counts need a byte-level BPE file that splits by one expression, with special strings taken as they stand")


class MergeCounter:
    """Counts the tokens of texts by the merges of a tokenizer file (byte-level BPE with a word-end suffix or none)."""

    def __init__(self, spec: dict):
        refuse_unlike(spec)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.symbol = [vocab[s] for s in byte_symbols()]
        self.last = [vocab[s + self.suffix] for s in byte_symbols()]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        kinds = [s["type"] for s in steps]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.heads = {s[0] for s in special}
        self.known: dict[str, int] = {}

    def merge_count(self, word: str) -> int:
        """Tokens of one pre-token: its bytes minus the merges that its pairs allow, lowest rank first."""
        data = word.encode()
        n = len(data)
        sym = [self.symbol[b] for b in data]
        sym[-1] = self.last[data[-1]]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, heap = self.pairs, []
        for i in range(n - 1):
            if found := pairs.get((sym[i], sym[i + 1])):
                heap.append((found[0], i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = pairs[a, b][1], -1
            right[i] = k = right[j]
            merges += 1
            if k < n:
                left[k] = i
                if found := pairs.get((sym[i], sym[k])):
                    heapq.heappush(heap, (found[0], i, sym[i], sym[k]))
            if (h := left[i]) >= 0 and (found := pairs.get((sym[h], sym[i]))):
                heapq.heappush(heap, (found[0], h, sym[h], sym[i]))
        return n - merges

    def _word(self, word: str) -> int:
        count = self.merge_count(word)
        if len(word) <= _CACHED_LENGTH:
            if len(self.known) >= _CACHED_WORDS:
                self.known.clear()
            self.known[word] = count
        return count

    def _plain(self, text: str) -> int:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # a capital sigma is lowered by itself, never to its final form
        known, total = self.known, 0
        for w in self.words.findall(text):
            total += known.get(w) or self._word(w)
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not any(h in text for h in self.heads):
            return self._plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])


@lru_cache(maxsize=2)
def counter(path: str) -> MergeCounter:
    with open(path, encoding="utf-8") as f:
        return MergeCounter(json.load(f))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``tokenizer`` is the file's place on each worker. No shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, rows = counter(tokenizer), texts(batch)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in rows], pa.int64()), pa.array(map(c.count, rows), pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    out = map_batches(id_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
