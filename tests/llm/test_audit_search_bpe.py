"""Filter audit, ranked lexical search and byte-level BPE against brute force, SQL and the public encoder."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tidemark.llm import byte_bpe, filter_audit, lexical, queries
from tidemark.llm.common import Generations


# ---- filter audit ----------------------------------------------------------------

def test_cells_of_sorted_lists():
    rng = random.Random(5)
    for _ in range(200):
        lists = [sorted(rng.sample(range(80), rng.randint(0, 60))) for _ in range(rng.randint(0, 5))]
        want = Counter(sum(1 << i for i, ids in enumerate(lists) if x in ids) for x in range(80))
        want.pop(0, None)
        assert filter_audit.cells(lists) == want
    assert filter_audit.cells([list(range(1000)), [999], []]) == {1: 999, 3: 1}


def fails_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            bool(re.search("[#$%&*|]", text))]


def audit_by_hand(rows, labels):
    docs = []
    for i, t, s in rows:
        t = t or ""
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        docs.append((s or "", fails_by_hand(t) + [copy], {k for d, *v in labels if d is not None and d == i for k in (0, 1) if v[k] == 1}))
    out, total = {}, Counter()
    for part in {p for p, *_ in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations(range(5)):
            for k, f in enumerate(order):
                left = [d for d in mine if not any(d[1][g] for g in order[:k])]
                here = [d for d in left if d[1][f]]
                total[part, f] += len(here)
                out[part, "".join("ABCDE"[g] for g in order), k + 1] = [
                    len(left) - len(here), len(here), sum(d[1][f] for d in mine) - len(here), sum(d[1][f] and sum(d[1]) == 1 for d in mine),
                    sum(0 in d[2] for d in here), sum(1 in d[2] for d in here), f]
    return {k: tuple(v[:-1]) + (total[k[0], v[-1]],) for k, v in out.items()}


def test_audit_by_hand(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    words = " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "a b", "A B C", words, words + " #", "x " * 80, words.upper(), "é" * 40 + " AB", long, long + " $"]
    rng = random.Random(3)
    rows = [(i, t, s) for i, (t, s) in enumerate((t, rng.choice(["p", "q", None, ""])) for t in texts * 3)]
    rows += [(None, words, "p"), (None, words, "p"), (7, words, "q"), (7, words, "q"), (40, "only here 5%", "r")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 33, 2)] + [(0, 1, 1), (0, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, row int, digest string").repartition(3)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got} == audit_by_hand(rows, labels)
    assert len(got) == 600 * 4  # p, q, r and the null part with the empty one
    none = filter_audit.filter_audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.count() == 0


def test_many_copies_of_a_text(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", "p") for i in range(3000)]  # over HOT_SHARE of all rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    later = filter_audit.later_copies(filter_audit.assess(docs))
    assert later.count() == 1999
    pair = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), *[(i, f"t{i}", "p") for i in range(3, 3000)]], docs.schema)
    assert [r.part for r in filter_audit.later_copies(filter_audit.assess(pair)).collect()] == ["q"]


# ---- lexical search --------------------------------------------------------------

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def search_by_hand(docs, items, k):
    terms = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    n, total = sum(bool(t) for t in terms), sum(sum(t.values()) for t in terms)
    df = Counter(x for t in terms for x in t)
    want = {}
    for i, t in items:
        want.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, need in want.items():
        scores = []
        for (doc, _), t in zip(docs, terms):
            m = 50 + 50 * sum(t.values()) * n // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * t[x] // (1000 * t[x] + 20 * m)) for x in need if t[x])
            if s > 0:
                scores.append((-s, doc is None, doc))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=str)


def test_search_by_hand(spark, docs_of):
    rng = random.Random(9)
    vocab = [f"t{i}" for i in range(30)] + ["Ñandú", "straße", "İ", "naïve", "x_y", "B2", "漢字"]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(150)]
    rows += [(i, "t1 t2; T3") for i in range(400, 420)]  # ties
    rows += [(500, None), (501, ""), (502, "-- !!"), (None, "t1 t2 t3 t4"), (None, "t1"), (3, "t1 t2 t3"), (3, "t1 t2 t3"), (600, "t5 " * 70_000)]
    items = [(1, "T1, t2? t3"), (2, None), (3, "nowhere"), (4, "ñandú Ñandú STRASSE straße i̇ İ"), (5, " ".join(vocab)), (5, "t1 more"),
             (6, "x y"), (6, "x y"), (None, "t7 t8")]
    docs = docs_of(rows).repartition(4)
    want = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, doc_id int, term int")
    for k, most in ((5, lexical.ROUND_TERMS), (200, 8)):
        got = lexical.search(docs, want, k=k, round_terms=most)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == search_by_hand(rows, items, k)
    assert lexical.search(docs.limit(0), want).count() == 0
    assert lexical.search(docs, want.limit(0)).count() == 0


def test_rounds_hold_their_bound(spark):
    terms = spark.createDataFrame([(i, f"t{j}".encode()) for i in range(40) for j in range(i)], "item long, term binary")
    rounds = [{(r.item, bytes(r.term)) for r in x.collect()} for x in lexical.in_rounds(terms, 100)]
    assert sum(map(len, rounds)) == len(set().union(*rounds)) == terms.count()
    assert all(len(r) <= 100 or len({i for i, _ in r}) == 1 for r in rounds)


def test_blocks_stay_exact():
    rng = np.random.default_rng(2)
    weights = rng.integers(1, 1 << 31, 50)  # so heavy that a block holds few columns
    items, cols = np.repeat(np.arange(4), 50), np.tile(np.arange(50), 4)
    tile = lexical.Tile(items, cols, weights, 0, 4, 50)
    assert len(tile.blocks) > 5
    docs, col, imp = np.repeat(np.arange(3), 50), np.tile(np.arange(50), 3), rng.integers(1, lexical.TOP_IMPACT, 150)
    want = [[sum(int(weights[c]) * int(imp[d * 50 + c]) for c in range(50)) for d in range(3)] for _ in range(4)]
    assert tile.scores(docs, col, imp, 3).tolist() == want


def test_best_keeps_ties_by_id():
    best = lexical.Best(2, 3)
    for ids in ([9, 4, 7], [5, 1, 8], [2, 6, 3]):
        best.add(0, np.array([[10, 10, 10], [0, 5, 0]]), np.array(ids), np.zeros(3, bool))
        best.settle()
    item, score, ids, _ = best.kept
    assert list(zip(item.tolist(), score.tolist(), ids.tolist())) == [(0, 10, 1), (0, 10, 2), (0, 10, 3), (1, 5, 1), (1, 5, 4), (1, 5, 6)]


# ---- byte-level BPE --------------------------------------------------------------

@pytest.fixture(scope="module")
def public():
    import tiktoken
    merger = byte_bpe.Merger(byte_bpe.read_ranks())
    return merger, tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=merger.ids, special_tokens={})


def test_encoder_equals_the_public_one(public):
    merger, tik = public
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab \n\t'st re€ñ9８　\x1c\x85.,!漢字\r", k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 30_000 + " x", "\n" * 3000, " " * 2000 + "z", "é" * 700, "x\n\ny", "\nx", " x", "x ", "x\n", "<|endoftext|>", ""]
    texts += [f"a{chr(c)}b {chr(c)} x" for c in rng.sample([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], 5000)]
    encode = byte_bpe.TextEncoder(merger)
    for k in range(0, len(texts), 1500):
        assert [byte_bpe.unpacked(x) for x in encode(texts[k:k + 1500])] == [tik.encode_ordinary(t) for t in texts[k:k + 1500]]


def test_long_words_equal_short_ones(public):
    merger, _ = public
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeñ", k=rng.randint(2, 300))).encode() for _ in range(300)]
    assert [merger._long(w) for w in words] == [byte_bpe.unpacked(x) if w not in merger.ids else merger._long(w)
                                                 for w, x in zip(words, merger.encode(words))]


def test_pair_table():
    left, right = np.array([1, 2, 3, 1], np.int32), np.array([2, 3, 1, 1], np.int32)
    table = byte_bpe.PairTable(left, right, np.arange(4, dtype=np.int32))
    assert table(left, right).tolist() == [0, 1, 2, 3]
    assert table(np.array([2, -1, 1], np.int32), np.array([1, 2, -1], np.int32)).tolist() == [byte_bpe.NONE] * 3


def test_generations_stay_bounded():
    g = Generations(10)
    for start in range(0, 200, 3):
        keys = set(range(start, start + 6))
        new = g.unknown(keys)
        g.young.update((k, k) for k in new)
        assert all(g.young[k] == k for k in keys) and len(g.young) + len(g.old) <= 40


def test_bpe_round_trip_query(spark):
    rows = queries.op13_byte_bpe(spark, SF_SMALL).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    merger = byte_bpe.Merger(byte_bpe.read_ranks())
    import tiktoken
    tik = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=merger.ids, special_tokens={})
    assert len(rows) == len(texts)
    for r in rows:
        ids = tik.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_of_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "dup"), (3, "dup"), (4, "word " * 60_000), (5, "x" * 90_000)]
    back = byte_bpe.decode(byte_bpe.encode(docs_of(rows)).withColumnRenamed("n_tokens", "decoded"), out="back").collect()
    assert sorted(((r.doc_id, bytes(r.back).decode()) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert byte_bpe.decode(byte_bpe.encode(docs_of(rows).limit(0))).count() == 0
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert bytes(byte_bpe.decode(byte_bpe.encode(bad)).first().decoded) == "a�b".encode()
    assert byte_bpe.decode(spark.createDataFrame([(None,)], "ids binary")).first().decoded == b""
