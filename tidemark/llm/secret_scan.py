"""Secret scans: fixed patterns, and a character convolutional network over every
further candidate with its context."""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, materialize, valid_text

KINDS = ("assign", "access", "hex")
# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run: the same as [0-9a-f]+ of 24 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.@-]{12,}")

BEFORE, INSIDE, AFTER = 24, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
STEP = 8  # between windows of a longer candidate: 33 characters in a row are whole in one of them
CLASSES = 24
ROUNDS = 12  # of training, over all windows
PART_WINDOWS = 4096  # that a task trains on by itself, about
_CODE = np.full(0x80, 1, np.uint8)
for _i, _chars in enumerate(("aeiou", "bcdf", "ghjklmnp", "qrstvwxyz", "AEIOU", "BCDF", "GHJKLMNP", "QRSTVWXYZ", "0123456789",
                             " \t", "\n\r", "=:", "\"'`", "-_", "/", "+", ".,;", "@", "#$%&*!?", "()[]{}<>", "|\\")):
    _CODE[[ord(_c) for _c in _chars]] = _i + 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base findings, by start, then kind."""
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Spans of 12 or more token characters with a digit, or that mix upper and
    lower case beyond a capital first letter, in ``start:end``."""
    out = []
    for m in CANDIDATE.finditer(text, start, len(text) if end is None else end):
        s = m[0]
        if not s.isalpha() and any(map(str.isdigit, s)) or not (s.islower() or s.isupper() or s[1:].islower()):
            out.append((m.start(), m.end()))
    return out


def strip(text: str, start: int, end: int) -> bytes:
    """Character classes of a candidate and its surroundings: ``BEFORE`` characters
    ahead, the candidate (filled to ``INSIDE``), and ``AFTER`` behind; 0 pads, 2
    stands for letters outside ASCII."""
    ahead, behind = _codes(text[max(0, start - BEFORE):start]), _codes(text[end:end + AFTER])
    return ahead.rjust(BEFORE, b"\0") + _codes(text[start:end]).ljust(INSIDE, b"\0") + behind.ljust(AFTER, b"\0")


def offsets(length: int) -> list[int]:
    """Where the windows of a candidate of this length begin, counted from its
    start: every ``STEP`` characters, and one that ends with it. ``WIDTH`` bytes of
    the strip from there are a window; what lies beside it is its context."""
    last = max(0, length - INSIDE)
    return [*range(0, last, STEP), last]


class Spans:
    """Whether a stretch of text touches one of some spans."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for s, _, e in sorted(spans):
            if self.ends and s <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def touch(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.ends) and self.starts[i] < end

    def beside(self, start: int, end: int) -> list[tuple[int, int]]:
        """The parts of ``start:end`` that no span touches."""
        out, i = [], bisect_right(self.ends, start)
        while i < len(self.ends) and self.starts[i] < end:
            out.append((start, self.starts[i]))
            start = self.ends[i]
            i += 1
        return [(s, e) for s, e in [*out, (start, end)] if s < e]

    def fill(self, start: int, end: int, within: tuple[int, int]) -> bool:
        """Whether ``start:end`` holds all that a span has of ``within``, or at least
        half of ``start:end`` lies in one."""
        i = bisect_right(self.ends, start)
        while i < len(self.ends) and self.starts[i] < end:
            s, e = max(self.starts[i], within[0]), min(self.ends[i], within[1])
            if start <= s and e <= end or 2 * (min(e, end) - max(s, start)) >= end - start:
                return True
            i += 1
        return False


def looked_at(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Every candidate with its strip and windows. One that a base finding touches
    has the windows that hold the finding or are half filled by it; what lies
    beside the finding follows by itself, if it is a candidate, with ``found``
    None: to be scored, but no label."""
    base, out = Spans(spans), []
    for s, e in candidates(text):
        found, at = base.touch(s, e), offsets(e - s)
        if found:
            at = [o for o in at if base.fill(s + o, min(e, s + o + INSIDE), (s, e))]
        out.append({"start": s, "end": e, "found": found, "at": at, "codes": strip(text, s, e)})
        if found:
            out += [{"start": a, "end": z, "found": None, "at": offsets(z - a), "codes": strip(text, a, z)}
                    for part in base.beside(s, e) for a, z in candidates(text, *part)]
    return out


def _codes(text: str) -> bytes:
    at = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(at < 0x80, _CODE[np.minimum(at, 0x7F)], 2).astype(np.uint8).tobytes()


class CharNet:
    """Embedding, one convolution over five characters, maximum and mean over
    the candidate and over its context, logistic output; trained by Adam with
    the context blanked in half of the draws, so that the candidate itself must
    carry some of the evidence."""

    SPAN, SIZE, FILTERS = 5, 6, 24
    #: Positions that read only the candidate, and all others: what stands before and after it.
    INNER = slice(BEFORE, BEFORE + INSIDE - SPAN + 1)
    AROUND = np.r_[:BEFORE, BEFORE + INSIDE - SPAN + 1:WIDTH - SPAN + 1]

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, .5, (CLASSES, self.SIZE)), "c": rng.normal(0, .2, (self.SPAN * self.SIZE, self.FILTERS)),
                  "b": np.zeros(self.FILTERS), "w": rng.normal(0, .2, 4 * self.FILTERS), "o": np.zeros(1)}
        self.rng = rng
        self.m, self.v, self.t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0  # Adam's means and steps
        self.scale, self.shift = 1.0, 0.0

    def _forward(self, x):
        p = self.p
        e = p["e"][x]
        e[x == 0] = 0
        cols = np.lib.stride_tricks.sliding_window_view(e, self.SPAN, axis=1).swapaxes(2, 3)
        cols = cols.reshape(len(x), WIDTH - self.SPAN + 1, -1)
        a = np.maximum(cols @ p["c"] + p["b"], 0)
        inside, around = a[:, self.INNER], a[:, self.AROUND]
        pooled = np.concatenate([inside.max(axis=1), inside.mean(axis=1), around.max(axis=1), around.mean(axis=1)], axis=1)
        return cols, a, pooled, pooled @ p["w"] + p["o"]

    def logits(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + step])[-1] for i in range(0, len(x), step)]) if len(x) else np.zeros(0)

    def calibrated(self, z):
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(x))

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, step: int = 64, rate: float = 5e-3,
              counts: tuple[int, int] | None = None) -> CharNet:
        """Goes on from where the last call stopped. ``counts``: rows and findings that
        the labels' weights follow, if these are a part of more."""
        n, found = counts or (len(y), y.sum())
        weight = np.where(y > 0, n / (2 * max(1, found)), n / (2 * max(1, n - found)))
        m, v, F_ = self.m, self.v, self.FILTERS
        for _ in range(rounds):
            order = self.rng.permutation(len(x))
            for i in range(0, len(x), step):
                at = order[i:i + step]
                xb = x[at].copy()
                blank = self.rng.random(len(xb)) < .5
                xb[blank, :BEFORE] = 0
                xb[blank, BEFORE + INSIDE:] = 0
                cols, a, pooled, z = self._forward(xb)
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) * weight[at] / len(at)
                g = {"w": pooled.T @ d, "o": d.sum(keepdims=True)}
                dp = d[:, None] * self.p["w"]
                da = np.zeros_like(a)
                rows, fs = np.arange(len(at))[:, None], np.arange(F_)[None, :]
                np.add.at(da, (rows, BEFORE + a[:, self.INNER].argmax(axis=1), fs), dp[:, :F_])
                da[:, self.INNER] += dp[:, None, F_:2 * F_] / (self.INNER.stop - self.INNER.start)
                np.add.at(da, (rows, self.AROUND[a[:, self.AROUND].argmax(axis=1)], fs), dp[:, 2 * F_:3 * F_])
                da[:, self.AROUND] += dp[:, None, 3 * F_:] / len(self.AROUND)
                da *= a > 0
                flat = da.reshape(-1, F_)
                g["c"], g["b"] = cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(axis=0)
                de = (da @ self.p["c"].T).reshape(len(at), -1, self.SPAN, self.SIZE)
                g["e"] = np.zeros_like(self.p["e"])
                for k in range(self.SPAN):
                    np.add.at(g["e"], xb[:, k:k + de.shape[1]], de[:, :, k])
                g["e"][0] = 0
                self.t += 1
                t = self.t
                for k in self.p:
                    m[k] = .9 * m[k] + .1 * g[k]
                    v[k] = .999 * v[k] + .001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - .9 ** t)) / (np.sqrt(v[k] / (1 - .999 ** t)) + 1e-8)
        return self


def mixed(nets: list[tuple[int, CharNet]]) -> CharNet:
    """The mean of networks (parameters and Adam's means), weighted by their rows."""
    total, net = sum(n for n, _ in nets), nets[0][1]
    for name in ("p", "m", "v"):
        setattr(net, name, {k: sum(n / total * getattr(o, name)[k] for n, o in nets) for k in net.p})
    return net


def below(n: int, recall: float) -> int:
    """How many of ``n`` findings may lie below the threshold."""
    return int(n * (1 - recall))


def threshold(p: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The largest threshold that keeps ``recall`` of the findings."""
    pos = np.sort(p[y > 0])
    return float(pos[below(len(pos), recall)]) if len(pos) else 1.1


def nth(values: DataFrame, n: int, bins: int = 1024) -> float:
    """The value of column ``z`` with ``n`` others before it in ascending order. The
    values are counted in bins, then those of the bin that holds it, until that is
    a single value."""
    low, high = values.agg(F.min("z"), F.max("z")).first()
    while low < high:
        at = F.least(F.floor((F.col("z") - low) / (high - low) * bins), F.lit(bins - 1))
        counted = values.where(F.col("z").between(low, high)).groupBy(at.alias("at")).agg(F.count("*"), F.min("z"), F.max("z")).collect()
        for _, count, low, high in sorted(counted):
            if n < count:
                break
            n -= count
    return low


def train(rows: DataFrame, counts: tuple[int, int]) -> CharNet:
    """A network trained on all ``rows(codes, found, h)``, ``counts`` of them and of the
    findings. The rows are dealt into parts of some ``PART_WINDOWS`` by a hash of the
    window. In each round every part trains the network over its own rows, and the
    mean of the parts' networks begins the next round."""
    parts = counts[0] // PART_WINDOWS + 1
    part = F.pmod(F.xxhash64("codes"), F.lit(parts)).alias("part")
    dealt = materialize(rows.select(part, F.struct((~F.col("found")).alias("other"), "h", "codes").alias("w")).repartition(parts, "part")
                        .groupBy("part").agg(F.sort_array(F.collect_list("w")).alias("ws")), "parts")
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("net", pa.binary())])
    net = CharNet()
    for _ in range(ROUNDS):
        start = pickle.dumps(net)

        def run(batches, start=start):
            for b in batches:
                for i, ws in zip(b.column("part").to_pylist(), b.column("ws").to_pylist()):
                    own = pickle.loads(start)
                    if i:  # other draws in each part
                        own.rng = np.random.default_rng((i, own.t))
                    x = np.frombuffer(b"".join(w["codes"] for w in ws), np.uint8).reshape(len(ws), WIDTH)
                    own.train(x, np.array([float(not w["other"]) for w in ws]), rounds=1, counts=counts)
                    yield pa.RecordBatch.from_pylist([{"part": i, "n": len(ws), "net": pickle.dumps(own)}], schema=schema)

        got = sorted(arrow_map(dealt, run, "part long, n long, net binary").collect())
        net = mixed([(r.n, pickle.loads(r.net)) for r in got])
    return net


def logits(rows: DataFrame, net: CharNet) -> DataFrame:
    """``(found, z)``: the network's logit of every window."""
    schema = pa.schema([("found", pa.bool_()), ("z", pa.float64())])

    def run(batches):
        for b in batches:
            x = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column("found"), pa.array(net.logits(x))], schema=schema)

    return materialize(arrow_map(rows.select("codes", "found"), run, "found boolean, z double"), "logits")


def platt(scored: DataFrame, counts: tuple[int, int], ridge: float = 1e-1, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift of the logits ``(found, z)``: logistic regression by Newton steps,
    each a sum over all rows."""
    n, found = counts
    scale, shift = 0.0, math.log((found + .5) / (n - found + .5))
    z = F.col("z")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z * scale + shift))))
        v, d = F.col("p") * (1 - F.col("p")), F.col("found").cast("double") - F.col("p")
        zz, z1, one, dz, d1 = scored.withColumn("p", p).agg(F.sum(v * z * z), F.sum(v * z), F.sum(v), F.sum(d * z), F.sum(d)).first()
        step = np.linalg.solve([[zz + ridge, z1], [z1, one + ridge]], [dz - ridge * scale, d1])
        scale, shift = scale + float(step[0]), shift + float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return scale, shift


def fit_network(scanned: DataFrame, recall: float = 0.95) -> tuple[CharNet, float] | None:
    """Network and threshold from all labelled findings: windows that hold a base
    finding are secrets, those of candidates without one are not. A fifth of them, by
    hash of place and id, is kept from training for calibration and threshold; where
    either side would have fewer than 3 of a label, all of them serve for both. None
    without both labels. The driver holds one network a part, and counts."""
    rows = (scanned.select("doc_id", F.explode("cands").alias("c")).select("doc_id", "c.*").withColumn("o", F.explode("at"))
            .where("found is not null")
            .withColumn("h", F.xxhash64("doc_id", F.col("start") + F.col("o"), "end"))
            .withColumn("codes", F.substring("codes", F.col("o") + 1, F.lit(WIDTH))))
    # the same window many times (copied documents) is one finding
    rows = materialize(rows.groupBy("codes", "found").agg(F.min("h").alias("h")), "windows")
    kept = F.col("h") % 5 == 0
    n = {(r.found, r.kept): r.n for r in rows.groupBy("found", kept.alias("kept")).agg(F.count("*").alias("n")).collect()}
    both = [(True, True), (True, False), (False, True), (False, False)]
    found, all_ = n.get(both[0], 0) + n.get(both[1], 0), sum(n.values())
    if not 0 < found < all_:
        return None
    if min(n.get(k, 0) for k in both) < 3:
        learn = aside = (rows, (all_, found))
    else:
        learn, aside = ((rows.where(w), (n[True, k] + n[False, k], n[True, k])) for k, w in ((False, ~kept), (True, kept)))
    net = train(*learn)
    scored = logits(aside[0], net)
    net.scale, net.shift = platt(scored, aside[1])
    # the rank is that of the probability
    some = scored.where("found").select((F.col("z") * (1 if net.scale >= 0 else -1)).alias("z"))
    z = nth(some, below(aside[1][1], recall)) * (1 if net.scale >= 0 else -1)
    return net, float(net.calibrated(z))


def best(net: CharNet, cands: list[dict], rows: int = 8192) -> list[float]:
    """The largest probability among the windows of each candidate."""
    top = np.zeros(len(cands))
    places = [(i, o) for i, c in enumerate(cands) for o in c["at"]]
    for k in range(0, len(places), rows):
        some = places[k:k + rows]
        x = np.frombuffer(b"".join(cands[i]["codes"][o:o + WIDTH] for i, o in some), np.uint8).reshape(len(some), WIDTH)
        np.maximum.at(top, [i for i, _ in some], net.probability(x))
    return top.tolist()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``(doc_id, findings)`` for every row of ``docs``: ``findings`` is a list of
    ``(kind, start, end, score)`` in code points (end exclusive), by start, then
    ``assign``, ``access``, ``hex``, ``model``.

    The texts are read once: base findings, and every candidate with its context,
    are written per document. The network learns from all labelled windows
    (``fit_network``) and scores every candidate that no base finding touches, and
    what lies beside the finding in the others, by its best window; those at or over the threshold are added with kind ``model``. Base findings
    always stay (score 1). Null and empty texts have none; invalid UTF-8 is read
    as U+FFFD; very long texts are read whole. Repeated ids and null ids give a row
    each, an empty table none; other columns are not read."""
    seen = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
                      ("cands", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("found", pa.bool_()), ("at", pa.list_(pa.int32())),
                                                       ("codes", pa.binary())])))])

    def read(batches):
        for b in batches:
            base, cands = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                spans = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                cands.append(looked_at(t, spans))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, seen.field(1).type), pa.array(cands, seen.field(2).type)], schema=seen)

    scanned = materialize(arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), valid_text(text_col).alias("text")), read,
        "doc_id long, base array<struct<start: long, kind: int, end: long>>,"
        " cands array<struct<start: long, end: long, found: boolean, at: array<int>, codes: binary>>"), "scanned")
    fitted = fit_network(scanned, **kw)
    out = pa.schema([("doc_id", pa.int64()), ("findings", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))])

    def judge(batches):
        names = (*KINDS, "model")
        for b in batches:
            base, cands = b.column("base").to_pylist(), b.column("cands").to_pylist()
            found = [[(x["start"], x["kind"], x["end"], 1.0) for x in xs] for xs in base]
            if fitted:
                net, least = fitted
                open_ = [(i, c) for i, cs in enumerate(cands) for c in cs if not c["found"]]
                for (i, c), p in zip(open_, best(net, [c for _, c in open_])):
                    if p >= least:
                        found[i].append((c["start"], 3, c["end"], p))
            rows = [[{"kind": names[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(fs)] for fs in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, out.field(1).type)], schema=out)

    return arrow_map(scanned, judge, "doc_id long, findings array<struct<kind: string, start: long, end: long, score: double>>")
