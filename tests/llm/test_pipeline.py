"""The pipeline against a brute-force version of its stages, and its queries against their SQL."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import language, mixing
from tidemark.llm.queries import ORACLES, QUERIES

from .test_operators import PlainBayes, frame, library_ids, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, SF).cache()
        assert current.columns == columns
        out[name] = current.collect()
    rows = docs.collect()
    plain = PlainBayes((r.text, r.lang) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    answers = {r.doc_id: plain.answer(r.text) for r in rows}
    assert {r.doc_id for r in out["language"]} == {d for d, (lang, score, gain) in answers.items() if lang != "und" and score >= language.LEAST_SCORE and gain >= language.LEAST_GAIN}

    groups = defaultdict(list)
    for r in out["language"]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    exact = {min(g)[1] for g in groups.values()}
    assert {r.doc_id for r in out["exact_dedup"]} == exact

    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in out["exact_dedup"]]
    assert {r.doc_id for r in out["near_dedup"]} == set(plain_components(prints).values())

    taken = {r.doc_id: r.taken for r in mixing.mix_sources(spark.createDataFrame(out["near_dedup"], docs.schema)).collect()}
    held = Counter()
    for r in out["mixing"]:
        held[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert held == Counter({d: n for d, n in taken.items() if n})

    packed = corpus_pipeline.STAGES[-1][1](spark, current, SF).collect()
    expected = Counter()
    for r in out["mixing"]:
        expected.update([(r.doc_id, len(library_ids(r.text, 1)))])
    per = defaultdict(int)
    for p in packed:
        per[p.doc_id] += p.length
    assert per == {d: sum(n * k for (e, n), k in expected.items() if e == d) for d in {e for e, _ in expected}}


def test_stages_take_odd_rows_and_columns(spark):
    odd = [(1, None, "en", None), (None, "the cat sat", None, "s"), (None, None, None, None), (2, "", "fr", "s"), (3, "the cat sat", "en", "s"), (3, "the cat sat", "en", "s"), (4, "THE cat\tsat ", "en", "t"), (5, "le chien et le chat", "fr", None), (6, "word " * 9000, "en", "t"), (7, "?!", "en", "t")]
    for rows in (odd, []):
        current = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, SF)
            assert current.columns == frame(spark, []).columns
        left = {r.doc_id for r in current.collect()}
        assert left <= {None, 3, 4, 5, 6} and bool(left) == bool(rows)
        assert corpus_pipeline.STAGES[-1][1](spark, current, SF).count() >= len(left)


def test_stages_delete_what_earlier_ones_made(spark, tmp_path):
    from pathlib import Path

    from tidemark.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    held = set(folder.glob("*"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = {p.name.split("-")[0] for p in set(folder.glob("*")) - held}
    assert not left & {"fresh", "near", "mix"} and "pieces" in left


def test_exact_dedup_reduces_before_it_shuffles(spark):
    from tidemark.llm import exact_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plans = []
    held = exact_dedup.written
    exact_dedup.written = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or held(df, name)
    try:
        exact_dedup.dedup_documents(docs)
    finally:
        exact_dedup.written = held
    partial, exchange = plans[0].index("partial_max_by"), plans[0].index("Exchange hashpartitioning(digest")
    assert plans[0].count("Exchange hashpartitioning(digest") == 1 and exchange < partial  # top down: the exchange stands above the partial aggregate


def test_run_ends_in_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 0


def test_exact_dedup_sql_on_repeated_ids(spark, tmp_path):
    rows = [(7, "a b"), (7, "a b"), (7, "ab"), (8, "a  b"), (8, "a b"), (None, "c"), (9, "c"), (None, None), (None, ""), (3, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    rel = con.sql(ORACLES["op4_exact_dedup"])
    got = QUERIES["op4_exact_dedup"](spark, str(tmp_path))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rel.fetchall()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert got.columns == rel.columns
    rounded = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert rounded(map(tuple, got.collect())) == rounded(rel.fetchall())


def test_model_is_bounded(spark):
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang"), fit_rows=50)
    assert model.weights.shape == (language.FEATURES, len(model.languages))
