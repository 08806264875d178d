"""The pipeline's stages, each against brute force on its own input, and on odd rows."""

from __future__ import annotations

import base64
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as C
from gaugeline.llm import decontaminate, rule_ensemble
from gaugeline.session import durable
from test_operators import base_spans, classes_by_brute_force, tiling_by_brute_force, words

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Inputs and outputs of all stages over the smallest tables."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, f in C.STAGES:
        after = durable(f(spark, docs, FOLDER), name)
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "decontaminated", "masked", "encoded"]
    assert entry.queries()["pipeline"] is C.run and "pipeline" not in entry.oracle_sql()


def test_quality_rejects_what_labels_call_bad(spark, stages):
    before, after, columns = stages[0]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = [(r.doc_id in kept) == bool(labels[r.doc_id]) for r in before if r.doc_id in labels]
    assert columns == COLUMNS and sum(right) >= 0.95 * len(right) and {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_one_document_of_each_class_stays(stages):
    before, after, columns = stages[1]
    classes = classes_by_brute_force([(r.doc_id, r.text) for r in before])
    assert columns == COLUMNS and sorted(r.doc_id for r in after) == sorted({c for _, _, c in classes})


def test_benchmark_passages_go(spark, stages):
    before, after, columns = stages[2]
    items = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def bad(text):
        w = words(text)
        own = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        return any(own & {tuple(x[i:i + 5]) for i in range(len(x) - 4)} and tiling_by_brute_force(w, x, 5) >= decontaminate.COVERAGE * len(x) for x in items)

    assert columns == COLUMNS and sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not bad(r.text))


def test_personal_data_is_masked(stages):
    before, after, columns = stages[3]
    new = {r.doc_id: r for r in after}
    assert columns == COLUMNS and set(new) == {r.doc_id for r in before}
    for r in before:
        spans = base_spans(r.text)
        assert new[r.doc_id].n_chars == len(new[r.doc_id].text) and not re.search(r"@[a-z0-9]+\.example", new[r.doc_id].text)
        if not spans:
            assert new[r.doc_id].text == r.text
        else:
            assert base_spans(new[r.doc_id].text) == []


def test_tokens_decode_to_the_text(stages):
    import tiktoken

    before, after, _ = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text for r in before}
    assert all(r.round_trip and np.frombuffer(r.token_ids, "<u4").tolist() == enc.encode_ordinary(text[r.doc_id]) for r in after) and len(after) == len(before)


def test_odd_rows(spark, tmp_path):
    """Null and empty texts, null and repeated ids, extra columns with clashing names, no rows."""
    good = " ".join(f"word{i % 37} and more{i}" for i in range(120))
    rows = [(1, good, "en", "a", 5), (1, good, "en", "a", 5), (2, None, None, None, None), (3, "", "en", None, 0), (None, good + " tail", "en", "b", 7), (None, None, None, None, None), (4, good[:400] + " mail x.y@z.org", "fr", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for c in ("_row", "_text", "_spans", "_score", "node", "cls", "seed", "_print"):
        docs = docs.withColumn(c, F.lit("clash"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "a b")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, f in C.STAGES[1:4]:
        out = f(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "near_duplicates":
            assert got[(1, good)] == 1 and got[(2, None)] == 1 and got[(3, "")] == 1 and got[(None, None)] == 1 and got[(4, rows[-1][1])] == 1
        elif name == "decontaminated":
            assert sum(got.values()) == len(rows)
        else:
            assert got[(4, good[:400] + " mail <EMAIL>")] == 1 and got[(None, None)] == 1 and got[(1, good)] == 2
        assert f(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    for f in (C.quality, C.encoded):
        assert f(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert C.quality(spark, docs, str(tmp_path)).count() <= len(rows) and rule_ensemble.THRESHOLD == 0.3
    assert C.encoded(spark, docs, str(tmp_path)).where("not round_trip").count() == 0


def test_texts_that_share_an_id_are_told_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a), (2, b), (3, a + " more"), (4, "zz zz zz"), (4, b + a), (None, a), (None, "no id here"), (None, "no id here"), (None, "no  ID here"), (5, ""), (5, None), (5, ""), (6, "w " * 40), (6, "w " * 40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for c in ("_id", "_print", "print", "component", "rows"):
        df = df.withColumn(c, F.lit("clash"))
    after = C.near_duplicates(spark, df.repartition(3), "")
    got = Counter((r.doc_id, r.text) for r in after.collect())
    assert after.columns == df.columns
    no_id = [t for (d, t) in got if d is None]
    assert len(no_id) == 1 and no_id[0].split()[0] == "no"
    assert Counter({k: v for k, v in got.items() if k[0] is not None}) == Counter([(1, a), (2, b), (4, "zz zz zz"), (4, b + a), (5, ""), (5, ""), (5, None), (6, "w " * 40)])
