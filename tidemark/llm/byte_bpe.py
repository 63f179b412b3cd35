"""Byte-level BPE: distinct words of a batch as padded matrices of ids in which
every row merges its leftmost pair of smallest rank each round."""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Generations, arrow_map, text_bytes

#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS_PATH = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
NONE = np.int32(2**31 - 1)
#: Cells of one matrix; rows longer than WIDEST are merged by a heap instead.
CELLS, WIDEST = 1 << 20, 1024
#: Tokens kept by a worker: two generations of at most this many.
CACHED = 300_000


class PairTable:
    """Open addressing in numpy arrays: (left id, right id) to the rank of the two
    together."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slot = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            slots, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slots], self.ranks[slots] = keys[put], rank[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, rank, slot = keys[rest], rank[rest], (slot[rest] + 1) & (1 << self.bits) - 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of flat arrays of pairs; ``NONE`` where there is none or an id is -1."""
        out = np.full(len(left), NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[at].astype(np.int64) << 32 | right[at]
        slot = self._slots(keys)
        while len(at):
            held = self.keys[slot]
            hit = held == keys
            out[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (held >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (1 << self.bits) - 1
        return out


class Merger:
    """The merges of a rank file (a base64 token and its rank a line)."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.bytes = {i: t for t, i in self.ids.items()}
        missing = [v for v in range(256) if bytes([v]) not in self.ids]
        if missing:
            raise ValueError(f"no rank for the bytes {missing}")
        self.byte = np.array([self.ids[bytes([v])] for v in range(256)], np.int32)
        get = self.ids.get
        pairs = [(a, b, r) for t, r in self.ids.items() for k in range(1, len(t))
                 if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None]
        self.table = PairTable(*(np.array(x, np.int32) for x in (zip(*pairs) if pairs else ((), (), ()))))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers. A word that
        is itself a token is that token, as in the public encoder."""
        out: list[bytes | None] = [None] * len(words)
        sizes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            known = self.ids.get(w)
            if known is not None or not w:
                out[i] = known.to_bytes(4, "little") if w else b""
            elif len(w) > WIDEST:
                out[i] = np.array(self._long(w), "<u4").tobytes()
            else:
                sizes.setdefault(-(-len(w) // 4) * 4 if len(w) <= 32 else 1 << (len(w) - 1).bit_length(), []).append(i)
        for width, at in sizes.items():
            for k in range(0, len(at), max(1, CELLS // width)):
                some = at[k:k + max(1, CELLS // width)]
                for i, ids in zip(some, self._matrix([words[i] for i in some], width)):
                    out[i] = ids
        return out

    def _matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Rounds over one bucket. All rows that go on lose one id a round, so the
        matrix loses a column; rows without a pair left are taken out."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < sizes[:, None], self.byte[raw], np.int32(-1))
        rank = self.table(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), width - 1)
        home = np.arange(len(words))
        out: list[bytes] = [b""] * len(words)
        while True:
            if rank.shape[1]:
                at = rank.argmin(axis=1)  # the first of equal ranks
                low = rank[np.arange(len(rank)), at]
                done = low == NONE
            else:
                done = np.ones(len(ids), bool)
            if done.any():
                flat, n = ids[done].astype("<u4"), (ids[done] >= 0).sum(axis=1)
                for i, row, k in zip(home[done].tolist(), flat, n.tolist()):
                    out[i] = row[:k].tobytes()
                go = ~done
                if not go.any():
                    return out
                ids, rank, home, at, low = ids[go], rank[go], home[go], at[go], low[go]
            r = np.arange(len(ids))
            ids[r, at] = low
            keep = np.ones(ids.shape, bool)
            keep[r, at + 1] = False
            ids = ids[keep].reshape(len(r), -1)
            keep = np.ones(rank.shape, bool)
            keep[r, at] = False
            rank = rank[keep].reshape(len(r), -1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.table(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < rank.shape[1])
            rank[right, at[right]] = self.table(ids[right, at[right]], ids[right, at[right] + 1])

    def _long(self, word: bytes) -> list[int]:
        """The same order of merges by a heap over linked ids, for a word so long
        that rounds over its whole row would take the square of its length."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n, token = len(ids), self.bytes
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := self.ids.get(token[ids[i]] + token[ids[j]])) is not None:
                heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            r, i, a, b = heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:  # one of the two has merged since
                continue
            ids[i], ids[j], nxt[i] = r, -1, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i, nxt[i])
            offer(prv[i], i)
        return [i for i in ids if i >= 0]


class TextEncoder:
    """Encodes lists of texts. A text whose white space is single spaces and line
    ends between other characters is cut by plain splitting: a match of the pattern
    begins at each of them, so what stands between two is encoded by itself, once.
    The matches of other texts are taken from the whole text. Tokens and words met
    before come from tables of two generations."""

    def __init__(self, merger: Merger):
        self.merger, self.find = merger, regex.compile(PATTERN).findall
        self.heads, self.tokens, self.words = Generations(CACHED), Generations(CACHED), Generations(CACHED)

    def __call__(self, texts: list[str]) -> list[bytes]:
        # after the first, a token has lost the space in front of it or begins with its line end
        cut = [t.replace("\n", " \n").split(" ") for t in texts]
        heads = self._learn(self.heads, {parts[0] for parts in cut}, "")
        token = self._learn(self.tokens, set().union(*cut), " ").__getitem__
        out: list[bytes | None] = []
        for parts in cut:
            try:
                out.append(heads[parts[0]] + b"".join(map(token, parts[1:])))
            except TypeError:  # holds a None
                out.append(None)
        hard = {i: self.find(texts[i]) for i, ids in enumerate(out) if ids is None}
        words = self._words(set().union(*hard.values()))
        for i, found in hard.items():
            out[i] = b"".join([words[w] for w in found])
        return out

    def _learn(self, table: Generations, tokens: set[str], space: str) -> dict[str, bytes | None]:
        """The table with the ids of the tokens; None for one that white space begins
        or ends."""
        plain, cut = [], {}
        for t in table.unknown(tokens):
            if t.isascii() and t.isalpha():  # one match
                plain.append(t)
            else:
                body = t[1:] if space and t[:1] == "\n" else t
                cut[t] = self.find(t if body is not t else space + t) if body and body == body.strip() else None
        words = self._words({space + t for t in plain}.union(*filter(None, cut.values())))
        table.young.update((t, words[space + t]) for t in plain)
        table.young.update((t, found and b"".join([words[w] for w in found])) for t, found in cut.items())
        return table.young

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """The table of words with the ids of these."""
        new = list(self.words.unknown(words))
        self.words.young.update(zip(new, self.merger.encode([w.encode() for w in new])))
        return self.words.young


@lru_cache(maxsize=2)
def merger(data: bytes) -> Merger:
    return Merger(data)


@lru_cache(maxsize=2)
def encoder(data: bytes) -> TextEncoder:
    """One per Python worker, so that later tasks find its words."""
    return TextEncoder(merger(data))


def read_ranks(path: str = RANKS_PATH) -> bytes:
    """The rank file's bytes (under a megabyte, shipped with the tasks)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str = RANKS_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row in one pass without a shuffle; ``ids``
    are packed little-endian unsigned 32-bit integers (``unpacked`` makes a list).

    Null and empty texts have no ids. Invalid UTF-8 is read as U+FFFD. Repeated rows
    and null ids give a row each, an empty table none. Very long texts and words are
    encoded whole. Other columns are not read."""
    data = read_ranks(ranks_path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        encode_texts = encoder(data)
        for b in batches:
            ids = encode_texts([t.decode("utf-8", "replace") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                             schema=schema)

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")), run,
                     "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str = RANKS_PATH, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes that their packed ids stand for in column ``out``
    (replaced if there); null ids are no bytes. An id without a rank fails."""
    data = read_ranks(ranks_path)
    kept = [c for c in encoded.columns if c != out]
    at = kept.index(ids_col)

    def run(batches):
        table = merger(data).bytes.__getitem__
        for b in batches:
            texts = [b"".join(map(table, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*kept, out])

    src = encoded.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return arrow_map(src, run, f"{fields}, `{out}` binary")


def unpacked(ids: np.ndarray | bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()
