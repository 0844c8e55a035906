"""Token counts by heap-and-linked-list byte-pair merging.

The text is cut as the tokenizer's file says (byte-level pre-tokenisation; the
file's added tokens are found first and count one each). The symbols of a piece
form a doubly linked list; a heap holds the adjacent pairs that have a merge,
by rank and place. Popping the lowest rank, skipping entries whose ends have
changed, joins two symbols. The piece's count is its initial symbols minus its
merges; no identifier is looked up or emitted.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted each; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from farelens.llm.common import arrow_map, texts

# Fixed value: the byte-level pre-tokenisation pattern that the vocabulary was made with.
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CACHE_PIECES = 400_000  # pieces remembered by a worker; a full cache starts anew

_LOADED: dict[str, "BytePairCounter"] = {}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable
    Latin-1 bytes stand for themselves, the others for code points from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    out.update({b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)})
    return out


class BytePairCounter:
    """Counts the tokens of texts for one byte-level BPE file."""

    def __init__(self, spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], pre["type"]) != ("BPE", "ByteLevel") or spec.get("normalizer") \
                or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without normaliser or prefix space are counted")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.seen: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        sym = [self.symbols[b] for b in piece.encode("utf-8")]
        n = len(sym)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.rank
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := (sym[i], sym[i + 1])) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (sym[i], sym[j]) != pair:
                continue  # one end has been merged since
            sym[i], sym[j] = pair[0] + pair[1], ""
            right[i] = k = right[j]
            right[j] = -1
            merges += 1
            if k >= 0:
                left[k] = i
                if (p := (sym[i], sym[k])) in rank:
                    heapq.heappush(heap, (rank[p], i, p))
            h = left[i]
            if h >= 0 and (p := (sym[h], sym[i])) in rank:
                heapq.heappush(heap, (rank[p], h, p))
        return n - merges

    def pieces(self, text: str) -> int:
        seen, total = self.seen, 0
        for piece in PIECES.findall(text):
            n = seen.get(piece)
            if n is None:
                if len(seen) >= CACHE_PIECES:
                    seen.clear()
                n = self.piece(piece)
                if len(piece) <= 64:
                    seen[piece] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if self.added is None:
            return self.pieces(text)
        total, at = 0, 0
        for m in self.added.finditer(text):
            total += self.pieces(text[at:m.start()]) + 1
            at = m.end()
        return total + self.pieces(text[at:] if at else text)


def _counter(name: str) -> BytePairCounter:
    """The worker's counter for a vocabulary file, loaded once per process."""
    if name not in _LOADED:
        import public_tokenizers
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            _LOADED[name] = BytePairCounter(json.load(f))
    return _LOADED[name]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json",
                 limit: int = 1024) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).
    A map: nothing is shuffled, a task holds one batch and its piece cache."""
    def run(batch: pa.RecordBatch):
        counter = _counter(vocabulary)
        column = batch.column("text")
        counts = [counter.count(t.as_py()) for t in column]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t.as_py().encode("utf-8")) for t in column], pa.int64()),
             pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return arrow_map(texts(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
