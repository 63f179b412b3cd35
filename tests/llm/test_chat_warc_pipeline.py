"""Chat formatting, WARC and the pipeline; every query with SQL against it."""

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm.test_dedup import components, slow_fingerprint
from tidemark.llm import chat, queries, warc
from tidemark.session import scratch_path
from tools.check_oracle import TABLES, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF_SMALL)
    res = con.execute(queries.ORACLE[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in res.description], res.fetchall())


def test_perspectives(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "ann", "hi"), (1, 2, "bob b", None), (1, 2, "bob b", None), (1, 3, None, "who"),
            (None, 0, "ann", "lost"), (2, 0, "system", "alone")] + [(3, None, "cat", f"m{i}") for i in range(7)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, part int")
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.perspectives(df, part_size=5).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob b", 0), (None, "ann", 0), (3, "cat", 0), (3, "cat", 1)}
    ann = got[1, "ann", 0]
    assert ann.text == ("<|im_start|>system\nbe < |kind|><|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                        "<|im_start|>user name=bob_b\n<|im_end|>\n<|im_start|>user name=bob_b\n<|im_end|>\n<|im_start|>user\nwho<|im_end|>\n")
    assert [ann.text[int(a):int(b)] for a, b in (x.split(":") for x in ann.mask.split(","))] == ["hi<|im_end|>"]
    assert got[3, "cat", 1].n_messages == 2 and got[1, "bob b", 0].n_messages == 5
    plan = chat.perspectives(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.perspectives(df.limit(0)).count() == 0


PAGES = [(3, "u", "x" * 200), (1, "u\r\nX-Evil: 1", "x" * 200), (2, None, "x" * 200), (4, "u", "y" * 99), (5, "u", "y" * 99), (6, "u", None),
         (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 40), (None, "u", "x" * 200), (1, "u", "x" * 200), (9, "u", "z" * 300_000)]


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip(spark, compress):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = scratch_path(spark, f"warc-{compress}-{id(pages)}")
    warc.write_archives(warc.plan_records(pages.repartition(3)), path, compress)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(PAGES)
    full = [r for r in rows if r.record_type == "response"]
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in full) == sorted(
        [(i, t or "") for i, _, t in PAGES if i is not None and (i not in (2, 3))])
    assert sorted(((r.page_id, r.refers_to, r.payload) for r in rows if r.record_type == "revisit"), key=str) == [
        (2, 1, None), (3, 1, None), (None, 1, None)]
    assert all("x-evil" not in r.headers for r in rows)
    picked = warc.read_archives(spark, path).where("record_type = 'revisit' and page_id in (2, 3, 8)").select("page_id")
    assert sorted(r.page_id for r in picked.collect()) == [2, 3]
    assert "record_type" not in str(picked._jdf.queryExecution().executedPlan()).split("BatchScan")[0]  # pushed down
    assert warc.read_archives(spark, path, payload=False).where("payload is not null").count() == 0


def test_warc_reads_foreign_members_and_unlisted_files(spark, tmp_path):
    one = warc.record([("WARC-Type", "response"), ("X-Page-ID", "no number")], b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody")
    two = warc.record([("WARC-Type", "warcinfo")], b"software: x")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + warc.member(one))
    (tmp_path / "b.warc").write_bytes(two + one)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, bytes(r.payload)) for r in rows) == [("response", b"body")] * 3 + [("warcinfo", b"software: x")] * 2
    assert gzip.decompress(warc.member(one)) == one


def test_repeated_messages_stay(spark):
    rows = [("c", None, "ann", "ok"), ("c", None, "bob", "hm"), ("c", None, "ann", "ok"), ("c", None, "ann", "ok")] + [("d", 1, "x", "again")] * 9
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn long, role string, text string, copies int")
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.perspectives(df, part_size=4).collect()}
    assert got["c", "bob", 0].text.count("user name=ann\nok<|im_end|>") == 3 and got["c", "ann", 0].mask.count(":") == 3
    assert [got["d", "x", p].n_messages for p in range(3)] == [4, 4, 1]
    long = spark.createDataFrame([(1, 1, "a", "w " * 100_000), (1, 2, "", "x")], "conv_id long, turn long, role string, text string")
    assert {len(r.text) > 200_000 for r in chat.perspectives(long).collect()} == {True}


def test_second_append_keeps_the_first(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i}", 1) for i in range(4)], "page_id long, url string, html string, payload int")
    path = str(tmp_path / "w")
    for i in range(3):
        warc.write_archives(warc.plan_records(pages.where(F.col("page_id") == i)), path)
    assert sorted(r.page_id for r in warc.read_archives(spark, path).collect()) == [0, 1, 2]
    warc.write_archives(warc.plan_records(pages.where("page_id = 3")), path, overwrite=True)
    assert [r.page_id for r in warc.read_archives(spark, path).collect()] == [3]
    assert len(list((tmp_path / "w").iterdir())) == 2 and warc.read_archives(spark, path).where("payload is null").count() == 0


def test_empty_archive(spark):
    path = scratch_path(spark, "warc-empty")
    warc.write_archives(warc.plan_records(spark.createDataFrame([], "page_id long, url string, html string")), path)
    assert warc.read_archives(spark, path).count() == 0


def test_pipeline_stages_by_hand(spark, docs_of, tmp_path):
    """Each stage does to planted documents what it is for, and keeps the columns."""
    clean = [(i, f"clean text number {i} " + " ".join(f"w{i}x{j}" for j in range(40)) + f"\nsecond line of {i}") for i in range(12)]
    item = " ".join(f"bench{j}" for j in range(40))
    copy = clean[3][1].replace("second line of 3", "another second line 3")
    rows = clean + [(50, f"intro words here\n{item}"), (60, clean[4][1]), (70, copy), (80, ""), (81, None), (None, "no id")]
    docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
    kept = {n: {r.doc_id for r in f(spark, docs, str(tmp_path)).collect()} for n, f in corpus_pipeline.STAGES[:4]}
    everyone = {i for i, _ in rows}
    assert kept["toxicity"] == everyone
    assert kept["line dedup"] == everyone - {60}
    assert kept["simhash near-dedup"] >= everyone - {60, 70, 81} and not {60, 81} & kept["simhash near-dedup"]
    assert kept["benchmark decontamination"] == everyone - {50}


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    n = spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    assert 0.5 * n < out.count() < n and out.where("not round_trip").count() == 0


def test_pipeline_against_brute_force(spark, docs_of, tmp_path):
    """Null and repeated ids: every row is judged by its own text."""
    rnd = random.Random(6)
    said = lambda i, bad: (f"note {i} " + " ".join(rnd.choice(("river", "table", "green", "paper", "window", "garden")) + str(rnd.randrange(999))
                                                   for _ in range(30)) + (" you filthy scumbag" if bad else " kind regards"))
    item = " ".join(f"bench{j}" for j in range(30))
    rows = [(i, said(i, i % 2)) for i in range(160)]
    rows += [(None, said(500, True)), (None, said(501, False)), (2, said(502, True)), (3, said(503, False))]
    rows += [(None, rows[4][1].replace(" ", "\n", 1)), (600, rows[6][1].replace(" ", "\n", 1)), (None, f"{item} tail"), (8, f"{item} end")]
    docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(10, 160)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    model = queries.toxicity_model(spark, docs, str(tmp_path))
    numbered = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    toxic = {r.doc_id for r in model.score(numbered).where(f"score >= {queries.THRESHOLD}").collect()}
    assert toxic == {k for k, (_, t) in enumerate(rows) if "scumbag" in t}
    left = [r for k, r in enumerate(rows) if k not in toxic]
    prints = [slow_fingerprint(t) for _, t in left]
    low = components(len(left), [(a, b) for a in range(len(left)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    group = {}
    for k, (i, t) in enumerate(left):
        group.setdefault(low[k], []).append((i is None, i or 0, t))
    left = [(None if no_id else i, t) for no_id, i, t in map(min, group.values())]
    want = [i for i, t in left if item not in t]
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want)
    # the null-id toxic text, near copy and leak are gone, the clean null-id row and the clean row of a toxic one's id are not
    assert got.count(None) == 1 and got.count(2) == 1 and got.count(3) == 1 and 8 in got and 600 not in got
