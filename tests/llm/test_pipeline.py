import hashlib

import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline as cp
from tessera.llm import bpe, quality
from tessera.llm.tables import written
from tests.conftest import SF_SMALL
from tests.llm.test_lines import blocks as lines_brute
from tests.llm.test_simhash import brute as prints_brute
from tests.llm.test_simhash import plain


def test_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and "pipeline" not in entry.oracle_sql()
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "tokens"]


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r for r in docs.collect()}
    frames = []
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, SF_SMALL), name)
        frames.append({r["doc_id"]: r for r in docs.collect()})
        if name != "tokens":
            assert docs.columns == columns
    scored, lined, single, mixed, coded = frames
    # quality: exactly the documents that the model accepts
    all_docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = quality.fit_on_labels(all_docs, spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    keep = {i for i, r in before.items() if model.scores([r["text"] or ""])[0] >= cp.MIN_QUALITY}
    assert set(scored) == keep and len(keep) < len(before)
    # lines
    gone = lines_brute({i: r["text"] for i, r in scored.items()}, 10)
    for i, r in scored.items():
        kept = "\n".join(x for p, x in enumerate(r["text"].split("\n")) if p not in gone[i])
        assert (i in lined) == bool(not gone[i] or kept.strip())
        if i in lined:
            assert lined[i]["text"] == kept and lined[i]["n_chars"] == (len(kept) if gone[i] else r["n_chars"])
    # near-duplicates
    root = prints_brute({i: plain(r["text"], 4) for i, r in lined.items()}, 4)
    assert set(single) == set(root.values())
    assert all(single[i] == lined[i] for i in single)
    # mixing: whole rows, within the budget, no leaf beyond what it has
    tokens = {i: len(r["text"].split()) for i, r in single.items()}
    assert set(mixed) < set(single) and all(mixed[i] == single[i] for i in mixed)
    assert 0.7 * sum(tokens.values()) <= sum(tokens[i] for i in mixed) <= 0.9 * sum(tokens.values())
    # tokens
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(coded) == set(mixed)
    for i, r in coded.items():
        assert r["ids"] == exact.encode_ordinary(mixed[i]["text"]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(mixed[i]["text"].encode()).hexdigest()


def test_stages_on_odd_rows(spark, make, empty):
    rows = [(1, None), (2, ""), (3, "some plain words of a text " * 20), (3, "some plain words of a text " * 20), (None, "no id at all"), (4, " \n ")]
    odd = make(rows).selectExpr("*", "'x' as fp", "1 as epoch")
    for name, stage in cp.STAGES:
        got = stage(spark, odd, SF_SMALL).collect()
        assert len(got) <= len(rows)
        assert stage(spark, empty, SF_SMALL).collect() == []


def test_one_row_of_each_group_where_ids_repeat(spark, make):
    one, two, three = (" ".join(f"{x}{k}" for k in range(60)) for x in ("red", "blue", "green"))
    rows = [(3, one), (7, one + " "), (7, two), (7, two), (8, two), (9, three), (9, one)]
    for parts in (1, 3, 5):
        got = cp.near_duplicate_stage(spark, make(rows, parts), SF_SMALL).collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, one), (7, two), (9, three)]
