"""SimHash, line dedup, embeddings and components against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import capfilter, linededup, simhash
from tidemark.llm.components import connected_components


def components(n, links):
    low = list(range(n))
    for _ in range(n):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_edge_cases_and_brute_force(spark, docs_of):
    rnd = random.Random(3)
    base = [rnd.choice("abcdefgh") + str(rnd.randrange(30)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "Ä B"), (5, "ä b"), (6, "ONE two three"), (6, "one two  three"), (7, "x " * 70_000), (None, "one two three")]
    for i in range(60):
        words = list(base)
        words[rnd.randrange(400)] = "z"
        rows.append((100 + i, " ".join(words)))
    got = simhash.simhash_groups(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = {(i, f"{slow_fingerprint(t):016x}") for i, t in rows}
    assert {(r.doc_id, r.fingerprint) for r in got} == want
    fps = sorted({int(f, 16) for i, f in want if i is not None})
    low = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2])
    first = {}
    for i, f in want:
        if i is not None:
            k = low[fps.index(int(f, 16))]
            first[k] = min(i, first.get(k, i))
    for r in got:
        assert r.component_id == (None if r.doc_id is None else first[low[fps.index(int(r.fingerprint, 16))]])
    assert simhash.simhash_groups(docs_of(rows).limit(0)).count() == 0


def test_hot_buckets_link_the_same_components(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4))) for _ in range(500)} | {rnd.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2}
    low = components(len(fps), [(fps.index(a), fps.index(b)) for a, b in want])
    for hot in (8, 10_000):
        links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(df, hot=hot).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        assert components(len(fps), [(fps.index(a), fps.index(b)) for a, b in links]) == low


def slow_lines(rows):
    norm = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(norm(x)) >= 10:
                holders.setdefault(norm(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(h := holders.get(norm(x), ())) > 1 and i != min(h))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a shared line here\nown line of one\nshort"), (2, " A Shared LINE here\t\nshort\nshort"), (3, None), (4, ""), (None, "a shared line here"),
        (5, "äöüäöüäöüä\nx"), (6, "äöüäöüäöüä"), (7, "äöüäöüäöü"), (8, "äöüäöüäöü"), (9, "twice in one doc\ntwice in one doc"),
        (10, "twice in one doc\r\na shared line here"), (11, "same id"), (11, "same id\na shared line here")]


def as_rows(df):
    from pyspark.sql import functions as F
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.h) for r in df.withColumn("h", F.sha2("text", 256)).collect()), key=str)


def test_line_dedup(spark, docs_of):
    docs = docs_of(ROWS)
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert as_rows(out) == slow_lines(ROWS)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_line_store_takes_documents_back(spark, docs_of):
    store = linededup.LineStore(spark, shards=3)
    first, second, gone = ROWS[:6], ROWS[6:], [ROWS[0], ROWS[9]]
    store.insert(docs_of(first))
    store.insert(docs_of(second))
    assert as_rows(store.rewrite(docs_of(ROWS))) == slow_lines(ROWS)
    store.delete(docs_of(gone))
    left = [r for r in ROWS if r not in gone]
    assert as_rows(store.rewrite(docs_of(left))) == slow_lines(left)
    held = {}
    for r in store.filters().collect():
        held.setdefault(r["shard"], []).append(linededup.CuckooFilter.load(bytes(r["filter"])))
    counts = store.counts().collect()
    assert all(any(bytes(r["key"]) in f for f in held[r["shard"]]) for r in counts)
    assert sum(f.members for fs in held.values() for f in fs) == len(counts)
    store.insert(docs_of(gone))
    assert as_rows(store.rewrite(docs_of(ROWS))) == slow_lines(ROWS)


def test_line_store_is_reopened_and_repeats_nothing(spark, docs_of, monkeypatch):
    store = linededup.LineStore(spark, shards=3)
    store.insert(docs_of(ROWS[:6]), batch="a")

    def fails(*_):
        raise OSError("stopped before the commit")
    with monkeypatch.context() as m:  # an insert that stops half-way is not there
        m.setattr(linededup.LineStore, "_commit", fails)
        with pytest.raises(OSError):
            store.insert(docs_of(ROWS[6:]), batch="b")
    store = linededup.LineStore(spark, path=store.path)
    store.insert(docs_of(ROWS[:6]), batch="a")
    store.insert(docs_of(ROWS[6:]), batch="b")
    store.insert(docs_of(ROWS[:9]))  # all held: by id, without a name
    assert as_rows(store.rewrite(docs_of(ROWS))) == slow_lines(ROWS)
    assert max(r["refs"] for r in store.counts().collect()) == 4
    store = linededup.LineStore(spark, path=store.path)
    store.delete(docs_of([(1, "edited since"), (9, None), (77, "never held")]))
    left = [r for r in ROWS if r[0] not in (1, 9)]
    assert as_rows(store.rewrite(docs_of(left))) == slow_lines(left)
    assert len(store.log) == len(linededup.LineStore(spark, path=store.path).log) == 4


def test_line_store_deals_to_more_shards(spark, docs_of, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 4)
    rows = [(i, f"line of its own {i}\nshared with the next {i // 2}") for i in range(120)]
    store = linededup.LineStore(spark, shards=2)
    for k in range(3):
        store.insert(docs_of(rows[k::3]))
    assert store.shards > 16
    assert as_rows(store.rewrite(docs_of(rows))) == slow_lines(rows)
    held = {}
    for r in store.filters().collect():
        held.setdefault(r["shard"], []).append(linededup.CuckooFilter.load(bytes(r["filter"])))
    counts = store.counts().collect()
    assert len(counts) == 180 and all(any(bytes(r["key"]) in f for f in held[r["shard"]]) for r in counts)


def test_cuckoo_filter_never_misses():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(4000)]
    f = linededup.CuckooFilter.sized(3000)
    for k in keys[:3000]:
        f.add(k)
    f = linededup.CuckooFilter.load(f.dump())
    assert all(k in f for k in keys[:3000]) and sum(k in f for k in keys[3000:]) < 10
    for k in keys[:1500]:
        f.remove(k)
    assert all(k in f for k in keys[1500:3000]) and sum(k in f for k in keys[:1500]) < 10


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    rows, i = [], 0
    for k, c in enumerate(centres):
        for _ in range(300 if k == 0 else 12):  # one large group
            v = c + rng.standard_normal(32) * rng.choice([.02, .3])
            rows.append((i, [float(x) for x in v], k % 3))
            i += 1
    rows += [(i, rows[0][1], 0), (i + 1, rows[0][1], 1), (i + 2, None, 0), (i + 3, [0.0] * 32, 0), (i + 4, [float("nan")] * 32, 0),
             (i + 5, [None] * 32, 0), (i + 6, rows[0][1], None), (i + 7, rows[0][1][:16], 0), (i + 8, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "2 as copies")
    got = {r.vec_id: r for r in capfilter.cosine_groups(df).collect()}
    ok = [r for r in rows if r[1] and r[2] is not None and len(r[1]) == 32 and all(x is not None and x == x for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= .93) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None, :])
    np.fill_diagonal(near, False)
    want = dict(zip([r[0] for r in ok], near.sum(axis=1).tolist()))
    assert len(got) == len(rows)
    assert all(got[k].n_links <= n for k, n in want.items())
    assert sum(got[k].n_links for k in want) >= .97 * sum(want.values())
    for r in rows:
        if r[0] not in want:
            assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True)
    assert capfilter.cosine_groups(df.limit(0)).count() == 0


def test_large_filters_are_split_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    c = rng.standard_normal(24)
    df = spark.createDataFrame([(i, (c + rng.standard_normal(24) * .01).tolist(), 1) for i in range(150)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(capfilter, "CHUNK", 32)
    got = capfilter.cosine_groups(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(149, 0)}


def test_embeddings_of_few_dimensions(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for dim in (1, 2, 4, 8, 9, 12, 16, 20):
        x = capfilter.unit(rng.standard_normal((120, dim)))
        turn = rng.standard_normal(x.shape)
        turn -= (turn * x).sum(axis=1, keepdims=True) * x
        x = np.concatenate([x, .935 * x + np.sqrt(1 - .935 ** 2) * capfilter.unit(turn)]) if dim > 1 else x
        near = capfilter.unit(x) @ capfilter.unit(x).T >= .93
        np.fill_diagonal(near, False)
        rows += [(1000 * dim + i, v.tolist(), 0) for i, v in enumerate(x)]
        want[dim] = near.sum(axis=1)
    got = {r.vec_id: r.n_links for r in capfilter.cosine_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    for dim, links in want.items():
        mine = np.array([got[1000 * dim + i] for i in range(len(links))])
        assert (mine <= links).all() and mine.sum() >= .97 * links.sum()
        assert dim >= capfilter.ALL_PAIRS or (mine == links).all()


def test_filters_of_a_vector_in_every_dimension():
    rng = np.random.default_rng(2)
    for dim in (12, 16, 32, 64, 128):
        found = capfilter.ProductCode(dim).decode(capfilter.unit(rng.standard_normal((500, dim))))
        assert 17 < np.mean([len(f) for f in found]) < 26


def test_codes_follow_the_size_of_a_label():
    """Planted pairs at cosine 0.93 share a filter at every level, and the vectors that
    a filter holds, of a label four times as large each, do not become more."""
    rng = np.random.default_rng(1)
    a, b = (capfilter.unit(rng.standard_normal((2000, 64))) for _ in range(2))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = .93 * a + np.sqrt(1 - .93 ** 2) * capfilter.unit(b)
    compared = []
    for level in range(4):
        code = capfilter.ProductCode(64, 12, *capfilter.level_code(12, 40, 3.0, level))
        mine, yours = code.decode(a), code.decode(b)
        assert np.mean([len(np.intersect1d(x, y)) > 0 for x, y in zip(mine, yours)]) >= .97
        held = np.unique(np.concatenate(mine), return_counts=True)[1]
        compared.append((held * (held - 1)).sum() / 2000 / 1999 * capfilter.LEVEL_ROWS * 4 ** level)
        assert np.mean([len(x) for x in mine]) < 40
    assert max(compared) <= 1.1 * compared[0]
    assert [capfilter.level_of(n) for n in (0, 8_000, 8_001, 32_000, 32_001, 10 ** 12)] == [0, 0, 1, 1, 2, capfilter.TOP_LEVEL]


def test_an_id_in_two_labels_joins_no_components(spark):
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((2, 16)).tolist()
    rows = [(5, x, 0), (7, x, 0), (5, y, 1), (9, y, 1), (1, [-v for v in x], 0)]
    got = {(r.vec_id, r.component_id, r.n_links) for r in capfilter.cosine_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {(5, 5, 1), (7, 5, 1), (9, 5, 1), (1, 1, 0)}
    rows = [(5, x, 0), (2, x, 0), (5, y, 1), (9, y, 1)]
    got = sorted((r.vec_id, r.component_id) for r in capfilter.cosine_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(2, 2), (5, 2), (5, 5), (9, 5)]


def test_labels_of_other_levels(spark, monkeypatch):
    """One label large enough for the next level, one not: the links of brute force."""
    rng = np.random.default_rng(11)
    x = capfilter.unit(rng.standard_normal((4600, 24)))
    near = capfilter.unit(x + .02 * rng.standard_normal(x.shape))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, near]))] + [(20_000 + i, v.tolist(), 1) for i, v in enumerate(x[:50])]
    got = {r.vec_id: r for r in capfilter.cosine_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    y = np.array([r[1] for r in rows[:9200]])
    want = sum(int((y[i:i + 500] @ y.T >= .93).sum()) for i in range(0, len(y), 500)) - len(y)
    found = sum(r.n_links for r in got.values())
    assert .97 * want <= found <= want and all(got[20_000 + i].n_links == 0 for i in range(50))
