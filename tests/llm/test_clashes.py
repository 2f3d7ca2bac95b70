"""Extra columns named like an operator's own, ids that are no integers, and plan details."""

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import langid, linededup, mixing, simhash

NAMES = ["end", "__level0", "__bucket", "__h", "__tokens", "__row", "__gone", "__th", "__id", "__langid", "__domain", "__score",
         "n_removed", "epoch", "row", "gone", "id", "th", "t", "n_tokens", "component", "fp", "a.b"]


def extra(df, drop=()):
    return df.withColumns({n: F.lit(f"kept {n}") for n in NAMES if n not in drop})


def unchanged(rows, drop=()):
    return all(r[n] == f"kept {n}" for r in rows for n in NAMES if n not in drop)


def test_mixing(make):
    df = make([(i, "one two three", "en", f"src{i % 3}") for i in range(30)])
    plain = {(r["doc_id"], r["epoch"]) for r in mixing.mix(df, ["lang", "source"], {}, F.expr("tokens div 2")).collect()}
    got = mixing.mix(extra(df), ["lang", "source"], {}, F.expr("tokens div 2")).collect()
    assert {(r["doc_id"], r["epoch"]) for r in got} == plain and len(plain) > 10
    assert unchanged(got, ("epoch", "n_tokens")) and all(r["n_tokens"] == 3 for r in got)


def test_lines_and_text_ids(make):
    passage = "\n".join(f"line {k} of a passage that several documents hold in full" for k in range(4))
    df = make([(1, passage), (2, f"own\n{passage}"), (None, passage)])
    got = linededup.dedup_lines(extra(df)).collect()
    assert unchanged(got, ("n_removed",)) and {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 4, None: 4}
    named = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(named).collect()} == {"d1": 0, "d2": 4, None: 4}


def test_language(make):
    df = make([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "² ½ 4 _", None), (4, "한", None), (5, "", None)])
    model = langid.fit(df.where("lang is not null"), public_tokenizers.path("piece_bpe_32k.model"))
    got = langid.identify(extra(df), model).collect()
    assert unchanged(got)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[1][0] == "en" and by[2][0] == "de" and by[3] == by[5] == ("und", 0.0) and by[4][0] in ("de", "en")


def test_words_gathered_over_chunks(make, monkeypatch):
    df = make([(i, f"the w{i} and x{i}", "en") for i in range(40)] + [(i, f"der v{i} und y{i}", "de") for i in range(40, 80)])
    model = langid.fit(df, public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r["text"] for r in df.orderBy("doc_id").collect()]
    want = [x for _, s in model.predict([texts]) for x in s]
    for fresh, chars, cache in ((1, 10, 10), (7, 10 ** 9, 5), (10 ** 9, 50, 10 ** 9)):
        monkeypatch.setattr(langid, "FRESH_WORDS", fresh)
        monkeypatch.setattr(langid, "FRESH_CHARS", chars)
        monkeypatch.setattr(langid, "CACHE_WORDS", cache)
        got = list(model.predict([texts[i:i + 3] for i in range(0, 80, 3)]))
        assert [len(s) for _, s in got] == [3] * 26 + [2] and [x for _, s in got for x in s] == want


def test_filing_runs_in_as_many_tasks_as_a_shuffle_has(spark):
    prints = spark.range(5000).select(F.xxhash64("id").alias("fp"))
    plan = simhash.fingerprint_links(prints, max_bits=4)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(xxhash64(fp" in plan


def test_pipeline_stages(spark, make):
    import corpus_pipeline as cp
    df = extra(make([(i, f"text number {i} with words of its own", "en", "src1") for i in range(12)]))
    for stage in (cp.line_stage, cp.near_duplicate_stage, cp.mixing_stage):
        got = stage(spark, df, "")
        assert got.columns == df.columns
        rows = got.collect()
        assert len(rows) > 8 and unchanged(rows)
