"""Unigram SentencePiece encoding and decoding.

The pieces of a model file stand in a double-array trie over UTF-8 bytes (built once, some MB whatever the
corpus). A text is marked as SentencePiece does (a leading blank, blanks as U+2581) and cut before each
run of marks; no piece of the vocabulary crosses such a cut (this is checked, and a vocabulary with
crossing pieces is encoded uncut), so the best path of a text is the best paths of its parts in a row. The
distinct parts of a batch are segmented together: one Viterbi step moves all of them along the trie.
A character no piece covers costs ten less than the lowest score and becomes byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType

MARK = "▁"
UNKNOWN_COST = 10.0
#: Texts of a batch are handled in groups of about this many characters.
GROUP_CHARS = 4_000_000


class Pieces:
    """A vocabulary ready for encoding: trie arrays, scores and the bytes of each piece."""

    def __init__(self, pieces: list[tuple[str, float, str]], dummy_prefix: bool = True):
        """``pieces`` in id order: text, log score, kind (normal, byte, unknown or control)."""
        self.dummy_prefix = dummy_prefix
        self.scores = np.array([s for _, s, _ in pieces], np.float32)
        self.byte_ids = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        self.unknown = 0
        words: dict[bytes, int] = {}
        for i, (text, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(text[3:5], 16)] = i
                self.surface.append(bytes([int(text[3:5], 16)]))
            elif kind == "normal":
                words[text.encode()] = i
                self.surface.append(text.replace(MARK, " ").encode())
            else:
                self.surface.append(b"")
                if kind == "unknown":
                    self.unknown = i
        self.has_bytes = any(kind == "byte" for _, _, kind in pieces)
        normal = [s for _, s, kind in pieces if kind == "normal"]
        self.unknown_score = np.float32(min(normal, default=0.0) - UNKNOWN_COST)
        self.cuts = not any(MARK in t.lstrip(MARK) for t, _, kind in pieces if kind == "normal")
        self.longest = max(map(len, words), default=0)
        self._build(words)

    def _build(self, words: dict[bytes, int]) -> None:
        """Place the children of each node, breadth first, at a base where all are free."""
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for word, i in words.items():
            node = 0
            for b in word:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = nxt
            ends[node] = i
        size = 4 * len(children) + 16384
        base, check, value = (np.full(size, -1, np.int32) for _ in range(3))
        place = {0: 0}
        check[0] = 0
        taken = np.zeros(size, bool)
        taken[0] = True
        free, queue = 1, [0]
        for node in queue:
            kids = sorted(children[node])
            at = place[node]
            value[at] = ends[node]
            base[at] = 0
            if not kids:
                continue
            start = max(free - kids[0], 1)
            while True:
                clash = taken[start + kids[0] : start + kids[0] + 4096].copy()
                for b in kids[1:]:
                    clash |= taken[start + b : start + b + 4096]
                if not clash.all():
                    start += int(clash.argmin())
                    break
                start += 4096
                if start + 8192 > size:
                    taken = np.concatenate([taken, np.zeros(size, bool)])
                    base, check, value = (np.concatenate([x, np.full(size, -1, np.int32)]) for x in (base, check, value))
                    size *= 2
            base[at] = start
            for b in kids:
                slot = start + b
                taken[slot] = True
                check[slot] = at
                place[children[node][b]] = slot
                queue.append(children[node][b])
            if taken[free]:
                ahead = taken[free : free + 4096]
                free += int(ahead.argmin()) if not ahead.all() else len(ahead)
        self.base, self.check, self.value = base, check, value

    def segment(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of the best path of each part."""
        out: list = [None] * len(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        lo = 0
        while lo < len(order):
            longest = lengths[order[lo]]
            hi = lo + 1
            while hi < len(order) and hi - lo < 16384 and lengths[order[hi]] <= longest + 1 + longest // 8:
                hi += 1
            group = order[lo:hi]
            for i, ids in zip(group.tolist(), self._paths([parts[i] for i in group]), strict=True):
                out[i] = ids
            lo = hi
        return out

    def _paths(self, parts: list[bytes]) -> list[np.ndarray]:
        n, width = len(parts), max(map(len, parts))
        length = np.fromiter(map(len, parts), np.int64, n)
        text = np.zeros((n, width), np.int32)
        flat = np.frombuffer(b"".join(parts), np.uint8)
        inside = np.arange(width) < length[:, None]
        text[inside] = flat
        best = np.full((n, width + 1), -np.inf, np.float32)
        best[:, 0] = 0
        start = np.full((n, width + 1), -1, np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        size = np.ones(256, np.int64)
        size[0xC0:0xE0], size[0xE0:0xF0], size[0xF0:] = 2, 3, 4
        limit = len(self.check)
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (i < length))
            if not len(rows):
                continue
            one = np.minimum(size[text[rows, i]], length[rows] - i)
            covered = np.zeros(len(rows), bool)
            at, live, state = rows, np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for k in range(1, min(self.longest, width - i) + 1):
                nxt = self.base[state] + text[at, i + k - 1]
                ok = (nxt < limit) & (i + k <= length[at])
                ok[ok] &= self.check[nxt[ok]] == state[ok]
                at, live, state = at[ok], live[ok], nxt[ok]
                if not len(at):
                    break
                ids = self.value[state]
                word = ids >= 0
                r, found = at[word], ids[word]
                covered[live[word]] |= one[live[word]] == k
                gain = best[r, i] + self.scores[found]
                better = gain > best[r, i + k]
                r, found = r[better], found[better]
                best[r, i + k], start[r, i + k], piece[r, i + k] = gain[better], i, found
            r = rows[~covered]
            if len(r):
                to = i + one[~covered]
                gain = best[r, i] + self.unknown_score
                better = gain > best[r, to]
                r, to = r[better], to[better]
                best[r, to], start[r, to], piece[r, to] = gain[better], i, -2
        return self._walk(parts, length, start, piece)

    def _walk(self, parts, length, start, piece):
        out = []
        for row, (part, end) in enumerate(zip(parts, length.tolist(), strict=True)):
            ids: list[int] = []
            begin, kind = start[row].tolist(), piece[row].tolist()
            unknown = False
            while end > 0:
                first = begin[end]
                if kind[end] >= 0:
                    ids.append(kind[end])
                    unknown = False
                elif self.has_bytes:
                    ids += [int(self.byte_ids[b]) for b in reversed(part[first:end])]
                elif not unknown:
                    ids.append(self.unknown)
                    unknown = True
                end = first
            out.append(np.array(ids[::-1], np.int32))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        index: dict[str, int] = {}
        cut = [self._cut(t) for t in texts]
        numbers = [np.fromiter((index.setdefault(p, len(index)) for p in parts), np.int64, len(parts)) for parts in cut]
        paths = self.segment([p.encode() for p in index])
        flat = np.concatenate(paths) if paths else np.empty(0, np.int32)
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        begins = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        out = []
        for k in numbers:
            many = sizes[k]
            total = int(many.sum())
            out.append(flat[np.repeat(begins[k] - np.cumsum(many) + many, many) + np.arange(total)])
        return out

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        marked = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        return PART.findall(marked) if self.cuts else [marked]

    def decode(self, ids: np.ndarray) -> str:
        got = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return got[1:] if self.dummy_prefix and got.startswith(" ") else got


PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def load_pieces(model_file: str) -> Pieces:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kinds = []
    for i in range(sp.get_piece_size()):
        kind = "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) or sp.is_unused(i) else "normal"
        kinds.append((sp.id_to_piece(i), sp.get_score(i), kind))
    return Pieces(kinds)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(documents: DataFrame, model_file: str | None = None) -> DataFrame:
    """``documents`` without its text, which the ids hold, with n_pieces, piece_ids (array<int>) and decoded_same: whether decoding the ids
    gives the text back. Null text gives nulls, empty text no ids. A text that holds U+2581 itself comes
    back with blanks there, so decoded_same compares with that. Columns of these names are replaced."""
    pieces = documents.sparkSession.sparkContext.broadcast(load_pieces(model_file or default_model()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value
        for batch in batches:
            texts = batch.column(batch.schema.names.index("text__"))
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                group: list = []
                while end < len(texts) and (chars < GROUP_CHARS or end == begin):
                    group.append(texts[end].as_py())
                    chars += len(group[-1] or "")
                    end += 1
                ids = known.encode([t or "" for t in group])
                sizes = [None if t is None else len(x) for t, x in zip(group, ids, strict=True)]
                same = [None if t is None else known.decode(x) == t.replace(MARK, " ") for t, x in zip(group, ids, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)),
                    mask=pa.array([t is None for t in group]),
                )
                part = batch.slice(begin, end - begin)
                kept = [part.column(i) for i, c in enumerate(batch.schema.names) if c != "text__"]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(sizes, pa.int32()), lists, pa.array(same, pa.bool_())],
                    names=[*[c for c in batch.schema.names if c != "text__"], "n_pieces", "piece_ids", "decoded_same"],
                )
                begin = end

    made = ("n_pieces", "piece_ids", "decoded_same")
    kept = [c for c in documents.columns if c.lower() not in (*made, "text")]
    slim = documents.select(*kept, F.col("text").alias("text__"))
    schema = documents.select(*kept).schema
    for name, kind in zip(made, (IntegerType(), ArrayType(IntegerType()), BooleanType()), strict=True):
        schema = schema.add(name, kind)
    return slim.mapInArrow(rows, schema)

