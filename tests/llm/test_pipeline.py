import duckdb
import numpy as np
import pytest

import corpus_pipeline
from docweave.llm import queries

from .test_operators import components_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of every stage, each written and read again."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(stages):
    docs, good, known, single, packed = stages
    for df in (good, known, single):
        assert df.dtypes == docs.dtypes
    labels = {r[0]: r[1] for r in duckdb.connect().sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()}
    kept = {r[0] for r in good.select("doc_id").collect()}
    marked = [d for d in (r[0] for r in docs.select("doc_id").collect()) if d in labels]
    assert np.mean([(d in kept) == (labels[d] == 1) for d in marked]) > 0.9
    assert known.count() >= 0.98 * good.count()
    rows = sorted((r.doc_id, r.text) for r in known.select("doc_id", "text").collect())
    _, root = components_of(rows)
    assert {r[0] for r in single.select("doc_id").collect()} == {rows[i][0] for i in set(root)}
    sums = {r[0]: r[1] for r in packed.groupBy("doc_id").sum("length").collect()}
    assert sums == {r[0]: r[1] for r in packed.select("doc_id", "doc_tokens").distinct().collect()} and sums.keys() == {r[0] for r in single.select("doc_id").collect()}
    assert max(r[1] for r in packed.groupBy("sequence_id").sum("length").collect()) <= 1024


def test_language_stage_drops_only_unknown_languages(spark, monkeypatch):
    rows = [(1, "en", 0.9), (2, "de", 0.3), (3, "und", 0.0)]
    monkeypatch.setattr(corpus_pipeline.langid, "train", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.langid, "predict", lambda docs, net, keep, names: docs.join(spark.createDataFrame(rows, f"doc_id long, {names[0]} string, {names[1]} double"), "doc_id"))
    docs = spark.createDataFrame([(i, "x") for i, *_ in rows], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()} == {1, 2}


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    """Columns that clash with the operators' own names go through every stage that keeps columns."""
    names = ["score", "lang_pred", "_id", "_th", "th", "_text", "text_", "score_", "id", "cls", "root", "_oth", "gone_id_"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) > 50 and all(tuple(r) == want[r.doc_id] for r in rows), name
    assert corpus_pipeline.pack(spark, docs, SF).count() > 0


def test_quality_rules_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.op7_quality_rules(spark, SF)
    rel = con.sql(queries.OP7_SQL)
    assert rel.columns == df.columns and sorted(tuple(r) for r in df.collect()) == sorted(rel.fetchall())


def test_registered_queries_against_the_libraries_and_brute_force(spark):
    """op2, op8 and op10 over the whole table as registered; op3's base and op6's labels with them."""
    import hashlib
    import math
    import zlib
    from collections import Counter

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from .test_operators import words_of

    docs = sorted(duckdb.connect().sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall())
    q = queries.queries()

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len(ids := lib.encode(t or "")), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t, _ in docs]
    assert sorted(tuple(r) for r in q["op2_sentencepiece"](spark, SF).collect()) == want

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, _ in docs}
    at, filled = Counter(), Counter()
    for r in sorted(q["op8_packing"](spark, SF).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()} and max(filled.values()) <= 1024
    assert sum(at.values()) / (1024 * len(filled)) > 0.97

    sets, root = components_of([(i, t) for i, t, _ in docs])
    assert sorted(tuple(r) for r in q["op10_jaccard_join"](spark, SF).collect()) == [(d[0], len(sets[k]), docs[root[k]][0]) for k, d in enumerate(docs)]

    rows = {r.doc_id: r for r in q["op3_suffix_lm"](spark, SF).collect()}
    count = Counter()
    for i, t, _ in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update([*words_of(t), None])
    n, v = sum(count.values()), len(count)
    for i, t, _ in docs:
        tokens = [*words_of(t), None]
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(count[x] > 0 for x in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens), rel_tol=1e-9) and r.score < 0
    known = [(r.lang_pred, x) for r, (_, _, x) in ((r, docs[k]) for k, r in enumerate(sorted(q["op6_language"](spark, SF).collect()))) if r.held_out and x]
    assert sum(a == b for a, b in known) >= 0.95 * len(known)


def test_url_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    ours = [tuple(r) for r in queries.op5_url_filter(spark, SF).collect()]
    assert sorted(ours, key=repr) == sorted(con.sql(queries.OP5_SQL).fetchall(), key=repr)


def test_queries_have_their_columns(spark):
    want = {
        "op1_html": "page_id url text n_chars",
        "op4_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9_quality_rank": "doc_id held_out score predicted",
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, SF).columns == columns.split()
