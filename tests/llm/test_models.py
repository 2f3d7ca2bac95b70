"""Quality classifier and language ID: held-out accuracy and defined cases."""
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import catalog, langid, quality
from tests.conftest import SF_MID

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_features_equal_plain_counting():
    texts = ["ab abc", "", "é x yz\n\nabc", "a"]
    ids, owner = quality.hashed_features(texts, 18)
    for k, t in enumerate(texts):
        words = [w for w in __import__("re").split(r"[\s\x85]+", t) if w]
        spaced = [" " + w + " " for w in words]
        n = len(words) + max(0, len(words) - 1) + sum(max(0, len(s) - g + 1) for s in spaced for g in quality.GRAMS)
        assert (owner == k).sum() == n
    repeated = [quality.hashed_features([w + " " + w], 18)[0].tolist() for w in ("abc", "xyz")]
    assert set(repeated[0]) & set(repeated[1])                  # a repetition is a feature of its own
    one, _ = quality.hashed_features(["abc"], 18)
    three, at = quality.hashed_features(["zz", "abc"], 18)
    assert sorted(one) == sorted(three[at == 1])


def test_quality_held_out(spark):
    got = catalog.QUERIES["op1_quality_classifier"](spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.9
    assert np.mean([r["predicted"] for r in held if r["quality"] == 1]) >= 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_cases(spark, make, empty):
    good, bad = "the river ran over the old stones ", "BUY!! NOW!! CHEAP!! "
    rows = [(i, (good if i % 2 else bad) * (1 + i % 5)) for i in range(60)]
    labelled = make(rows).withColumn("label", (F.col("doc_id") % 2).cast("int"))
    extra = spark.createDataFrame([(None, good, "en", "s", 1, 1), (99, good, "en", "s", 1, None), (98, bad, "en", "s", 1, 7)], labelled.schema)
    model = quality.fit(labelled.unionByName(extra))
    odd = make([(1, None), (2, ""), (3, good * 3000), (3, good * 3000), (None, bad)]).withColumn("score0", F.lit(1))
    got = {r["doc_id"]: r["s"] for r in quality.score(odd, model, out_col="s").collect()}
    assert got[1] == got[2] and got[3] > 0.5 > got[None]
    assert quality.score(empty, model).collect() == []
    flat = quality.fit(labelled.where("label = 1"))
    assert flat.scores(["x"])[0] > 0.9
    assert quality.fit(labelled.limit(0)).scores(["x"])[0] == 0.5


def brute_word(word, prob):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = prob.get(word[:k], langid.UNKNOWN if k == 1 else 0.0)
        if p:
            total += p * brute_word(word[k:], prob)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "bab", "▁ab", "c", "abab"]
    prob = np.array([[0.01 * (i + 1), 0.02 * (9 - i)] for i in range(9)])
    table = langid.PieceTable(pieces, bits=4)
    words = ["ab", "abab", "cab", "zab", "b", "ababababab", "é"]
    got = langid.word_loglik(words, table, prob)
    for w, row in zip(words, got):
        for lang in (0, 1):
            want = brute_word("▁" + w, dict(zip(pieces, prob[:, lang])))
            assert abs(row[lang] - np.log(want)) < 1e-9
    long = langid.word_loglik(["ab" * 2000], table, prob)
    assert np.isfinite(long).all() and long[0, 0] < -1000


def test_langid_held_out(spark):
    got = catalog.QUERIES["op8_language_id"](spark, SF_MID)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_langid_cases(make, empty):
    rows = [(i, "the cat and the dog went with them " * 3, "en") for i in range(10)]
    rows += [(i, "le chat et le chien sont avec nous dans la maison " * 3, "fr") for i in range(10, 20)] + [(30, "xx", None)]
    model = langid.fit(make(rows), PIECES)
    assert model.langs == ["en", "fr"]
    odd = make([(1, None), (2, ""), (3, "123 !!"), (4, "the dog " * 20_000), (5, "dans la maison"), (5, "dans la maison"), (None, "the cat"),
                (6, "字" * 5000)]).withColumnRenamed("source", "__langid2")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert len(got) == 8 and by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == by[None][0] == "en" and by[5][0] == "fr" and by[6][0] in ("en", "fr")
    assert langid.identify(empty, model).collect() == []
    nothing = langid.fit(make([(1, "a", None)]), PIECES)
    assert [r["lang_pred"] for r in langid.identify(make([(1, "abc")]), nothing).collect()] == ["und"]
