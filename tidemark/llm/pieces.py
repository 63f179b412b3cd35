"""SentencePiece encoding and decoding: Viterbi over a batch's distinct marked
words, sorted so that shared prefixes are scored once."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Generations, arrow_map, small_batches, valid_text

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
CACHED_WORDS = 120_000
CACHED_PAIRS = 500_000
ENCODED_BYTES = 2 << 20


class Vocabulary:
    """Pieces, scores and special ids of a model file with an identity
    normaliser and byte fallback (others are refused)."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto.FromString(proto)
        norm, spec = model.normalizer_spec, model.trainer_spec
        self.kind = spec.model_type
        if self.kind not in (UNIGRAM, BPE) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not spec.byte_fallback:
            raise ValueError("needs a unigram or BPE model with byte fallback and an identity normaliser")
        self.dummy = norm.add_dummy_prefix
        self.names = [p.piece for p in model.pieces]
        self.byte = [0] * 256
        self.ids, self.scores = {}, [p.score for p in model.pieces]
        for i, p in enumerate(model.pieces):
            if p.type == 6:  # byte
                self.byte[int(p.piece[3:5], 16)] = i
            elif p.type in (1, 4):  # normal, user-defined
                self.ids[p.piece] = i
        self.rank: dict[str, int] = {}  # merge order; 0 for single characters
        self.halves: dict[str, tuple[str, str]] = {}  # what a piece's last merge joins
        if self.kind == BPE:  # a piece that merging never makes is out of reach
            for p in sorted(self.ids, key=lambda p: -self.scores[self.ids[p]]):
                parts = self._merged(p, stop=2) if len(p) > 1 else [p]
                if len(parts) == 2 and parts[0] + parts[1] == p:
                    self.halves[p], self.rank[p] = (parts[0], parts[1]), len(self.rank) + 1
                elif len(p) > 1:
                    del self.ids[p]
        self._index()
        self.alone = "" if any("\n" in p and p != "\n" for p in self.ids) else "\n"
        self.worst = min(self.scores, default=0.0) - 10.0
        # what a piece stands for in the decoded bytes
        self.bytes = [p.replace(MARK, " ").encode() if p in self.ids else b"" for p in self.names]
        for v, i in enumerate(self.byte):
            self.bytes[i] = bytes([v])
        self._pairs: dict[int, bool] = {}

    def _index(self) -> None:
        """The pieces as a suffix-linked trie (Aho-Corasick). A state stands for the longest
        ending of what was read that begins a piece; ``ends`` has the pieces of two and
        more characters that end there as (id, minus the length), longest first;
        ``ones`` the pieces of one."""
        self.next = [{}]
        self.ones = {p: i for p, i in self.ids.items() if len(p) == 1}
        whole = {}
        for p, i in self.ids.items():
            at = 0
            for c in p:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                at = to
            if len(p) > 1:
                whole[at] = ((i, -len(p)),)
        self.short, self.ends = [0] * len(self.next), [()] * len(self.next)
        level = [0]
        while level:  # by depth: the shorter endings are ready
            below = []
            for at in level:
                for c, to in self.next[at].items():
                    if at:
                        self.short[to] = self.step(self.short[at], c)
                    self.ends[to] = whole.get(to, ()) + self.ends[self.short[to]]
                    below.append(to)
            level = below

    def step(self, at: int, c: str) -> int:
        """The state after one more character."""
        while True:
            to = self.next[at].get(c)
            if to is not None:
                return to
            if not at:
                return 0
            at = self.short[at]

    def _merged(self, text: str, stop: int = 1) -> list[str]:
        """Merge the best-scored neighbouring pair, leftmost first, until none is
        left or ``stop`` parts are."""
        parts = list(text)
        while len(parts) > stop:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1)
                        if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def beside(self, a: str, b: str) -> bool:
        """BPE leaves the pieces ``a`` and ``b`` side by side. The later of their
        last merges is undone, again and again: at each stage, merging what
        touches must not come before the merge just undone."""
        rank, halves, limit = self.rank, self.halves, 1 << 60
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            x, y = rank.get(a, 0), rank.get(b, 0)
            if x > y:
                limit, a = x, halves[a][1]
            elif y:
                limit, b = y + 1, halves[b][0]
            else:
                return True

    def _fit(self, a: int, b: int) -> bool:
        """``beside`` of ids, kept; a character that is no piece has -1 less its code, the
        word's beginning the id after the last."""
        if len(self._pairs) >= CACHED_PAIRS:
            self._pairs.clear()
        n = len(self.names)
        known = self._pairs[a * (n + 1) + b] = a == n or self.beside(self.names[a] if a >= 0 else chr(-1 - a), self.names[b])
        return known

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words."""
        words, ids, ends = self.walk(words)
        return {w: ids[s:e] for w, s, e in zip(words, [0, *ends], ends)}

    def walk(self, words: list[str]) -> tuple[list[str], list[int], list[int]]:
        """Distinct words in sorted order, their ids one after the other, and where those
        of each word end. The words are walked in sorted order, which is
        the depth-first order of their trie; the forward tables of the prefix
        that a word shares with the one before are kept, only the rest is scored.

        Unigram: the best sum of scores ending at each position (of equal sums,
        the longer last piece). BPE: only steps between pieces that merging
        leaves side by side are allowed; one path remains and it is the model's.
        A character that is no piece costs more than any piece and is written as
        its bytes."""
        words, flat, until, found = sorted(words), [], [], []
        # by end: state of the trie, the last piece's id, score
        state, last, best = [0], [len(self.names)], [0.0]
        prev = ""
        scores, after, short, ends, ones, bpe, many = self.scores, self.next, self.short, self.ends, self.ones, self.kind == BPE, len(self.names) + 1
        fits, length = self._pairs.get, [*map(len, self.names)]
        for word in words:
            same = 0
            for c, d in zip(prev, word):
                if c != d:
                    break
                same += 1
            del state[same + 1:], last[same + 1:], best[same + 1:]
            at = state[same]
            for c in word[same:]:
                to = after[at].get(c)
                while to is None and at:
                    at = short[at]
                    to = after[at].get(c)
                at = to or 0
                state.append(at)
                if bpe:  # longest first; a step of one character is open to every path
                    for i, back in ends[at]:
                        known = fits(last[back] * many + i)
                        if known or known is None and self._fit(last[back], i):
                            break
                    else:
                        i = ones.get(c)
                        if i is None:
                            i = -1 - ord(c)
                    last.append(i)
                    continue
                top = None
                for i, back in ends[at]:
                    score = best[back] + scores[i]
                    if top is None or score > top:
                        top, piece = score, i
                i = ones.get(c)
                score = best[-1] + (self.worst if i is None else scores[i])
                if top is None or score > top:
                    top, piece = score, -1 - ord(c) if i is None else i
                best.append(top)
                last.append(piece)
            end = len(word)
            while end:
                i = last[end]
                if i >= 0:
                    found.append(i)
                    end -= length[i]
                else:
                    found.extend([self.byte[x] for x in reversed(chr(-1 - i).encode())])
                    end -= 1
            found.reverse()
            flat += found
            found.clear()
            until.append(len(flat))
            prev = word
        return words, flat, until

    def words(self, text: str) -> list[str]:
        """Marked words: a run of marks and what follows up to the next mark. No
        piece spans such a border (or a line end, if no piece holds one)."""
        if not text:
            return []
        text = (MARK if self.dummy else "") + text.replace(" ", MARK)
        return self._cut.findall(text)

    @property
    def _cut(self):
        return _cutter(self.alone)

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes
        data = b"".join([table[i] for i in ids])
        return (data[1:] if self.dummy and data[:1] == b" " else data).decode("utf-8", "replace")


@lru_cache
def _cutter(alone: str):
    return re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))


@lru_cache(maxsize=4)
def vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


class BatchEncoder:
    """Encodes lists of texts. Words met before come from tables of two generations
    (each of at most ``CACHED_WORDS`` and a batch's words); the new ones of a batch go
    through the trie together.

    A text without runs of spaces is cut by plain splitting: a token stands for
    its marked word, a token that begins with a line end for that line end and
    an unmarked word. Other texts go through ``Vocabulary.words``."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.tokens, self.marked = vocab, Generations(CACHED_WORDS), Generations(CACHED_WORDS)
        self.plain = vocab.dummy and vocab.alone == "\n"
        self.line_end = array("i", [vocab.ids.get("\n", vocab.byte[10])]).tobytes()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of the texts."""
        easy = [self._plain(t) for t in texts]
        cut = [t.replace("\n", " \n").split(" ") if e else self.vocab.words(t) for e, t in zip(easy, texts)]
        tokens = self.tokens.unknown(set().union(*(ws for e, ws in zip(easy, cut) if e)))
        marked = self.marked.unknown(set().union(*(ws for e, ws in zip(easy, cut) if not e)))
        words = {t: t[1:] if t[:1] == "\n" else MARK + t for t in tokens}
        walked, ids, ends = self.vocab.walk(list(marked.union(words.values()) - {""}))
        data = array("i", ids).tobytes()
        new = {w: data[4 * s:4 * e] for w, s, e in zip(walked, [0, *ends], ends)}
        self.marked.young.update((w, new[w]) for w in marked)
        self.tokens.young.update((t, self.line_end + new.get(w, b"") if t[:1] == "\n" else new[w]) for t, w in words.items())
        known, apart = self.tokens.young.__getitem__, self.marked.young.__getitem__
        flat = [b"".join(map(known if e else apart, ws)) for e, ws in zip(easy, cut)]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in flat])))
        return np.frombuffer(b"".join(flat), np.int32), offsets.astype(np.int32)

    def _plain(self, text: str) -> bool:
        return (self.plain and text != "" and "  " not in text and " \n" not in text and MARK not in text and text[0] != " ")


@lru_cache(maxsize=2)
def encoder(proto: bytes) -> BatchEncoder:
    """One per Python worker, so that later tasks find its words."""
    return BatchEncoder(vocabulary(proto))


def read_model(path: str = MODEL_PATH) -> bytes:
    """The model file's bytes (half a megabyte, shipped with the tasks)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, n_ids, round_trip)`` for every row, in one pass
    without a shuffle. ``round_trip``: decoding gives the text back (a text that
    holds U+2581 does not, as that is the mark of a space). Null and empty texts
    have no ids and round-trip. Invalid UTF-8 is read as U+FFFD. Repeated rows and
    null ids give a row each, an empty table none; very long texts are encoded
    whole; other columns are not read."""
    proto = read_model(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches):
        vocab, encode_batch = vocabulary(proto), encoder(proto)
        for part in small_batches(batches, ENCODED_BYTES):
            texts = [t or "" for t in part.column(1).to_pylist()]
            flat, offsets = encode_batch(texts)
            listed = flat.tolist()
            same = [vocab.decode(listed[s:e]) == t for t, s, e in zip(texts, offsets.tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                                              pa.array(np.diff(offsets).astype(np.int64)), pa.array(same)], schema=schema)

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), valid_text(text_col).alias("text")), run,
                     "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from lists of ids; a null list is an empty text."""
    proto = read_model(model_path)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        vocab = vocabulary(proto)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vocab.decode(x or []) for x in b.column(1).to_pylist()], pa.string())],
                                             schema=schema)

    return arrow_map(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text string")
