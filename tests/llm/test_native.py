"""Licence scan and mixing: DuckDB parity and defined cases."""
import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.llm import catalog, licences, mixing
from tests.conftest import SF_MID, SF_SMALL

NAMES = ["op2_license_scan", "op4_source_mixing"]


def rows_of(names, rows):
    return sorted(repr(tuple(r[c] for c in sorted(names))) for r in rows)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(catalog.ORACLE[name])
    cols = [d[0] for d in cur.description]
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    got = [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]
    assert sorted(got[0]) == sorted(cols)
    assert rows_of(cols, got) == rows_of(cols, want)


@pytest.mark.parametrize("name", NAMES)
def test_native_plan(spark, name):
    df = catalog.QUERIES[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoop"))


def test_licence_spellings(make):
    mit = next(t for i, k, t in licences.KNOWN if (i, k) == ("MIT", "text"))
    rows = [(1, "Some text.\nreleased under the MIT LICENCE\nmore"), (2, mit.upper()),
            (3, "Copyright (c) 2020 Somebody\n" + mit.replace("Software", "software") + "\nAll rights reserved."),
            (4, mit + " And one more sentence."), (5, None), (6, ""), (7, "Licensed under CC BY-NC 4.0.\n" * 3), (None, "no licence"),
            (8, "released under the mit license"), (8, "released under the mit license")]
    got = {(r["doc_id"], r["license_id"], r["scope"]): r["n_matches"] for r in licences.scan(make(rows)).collect()}
    assert got == {(1, "MIT", "line"): 1, (2, "MIT", "document"): 1, (3, "MIT", "document"): 1, (4, None, None): None,
                   (5, None, None): None, (6, None, None): None, (7, "CC-BY-NC-4.0", "line"): 3, (None, None, None): None,
                   (8, "MIT", "document"): 2}


def test_licence_empty_and_own_list(spark, make, empty):
    assert licences.scan(empty).collect() == []
    own = licences.known_digests(spark, [("X", "text", "You may do as you like")])
    got = licences.scan(make([(1, "You may do, as you LIKE!")]), known=own).collect()
    assert [(r["license_id"], r["scope"]) for r in got] == [("X", "document")]


def plain_budgets(tree, weights, budget):
    """Water filling by rounds, the slow way. tree: nested dicts, leaves capacities."""
    def cap(t):
        return t if isinstance(t, int) else sum(map(cap, t.values()))
    out = {}

    def down(t, b, path):
        if isinstance(t, int):
            out[path] = b
            return
        give = {k: 0.0 for k in t}
        left, open_ = float(b), {k for k in t if cap(t[k]) > 0}
        while open_ and left > 1e-9:
            total = sum(weights.get(k, 1) for k in open_)
            part = {k: left * weights.get(k, 1) / total for k in open_}
            left = 0.0
            for k, x in part.items():
                take = min(x, cap(t[k]) - give[k])
                give[k] += take
                left += x - take
            open_ = {k for k in open_ if give[k] < cap(t[k]) - 1e-9}
        for k in t:
            down(t[k], give[k], path + (k,))
    down(tree, budget, ())
    return out


def test_budgets_equal_rounds_of_filling(spark):
    tree = {"a": {"x": {"s1": 100, "s2": 900}, "y": {"s1": 50}}, "b": {"x": {"s3": 30, "s4": 4000}}, "c": {"z": {"s5": 10}}}
    weights = {"a": 3, "b": 1, "c": 5, "x": 2, "s2": 4}
    leaves = spark.createDataFrame([(d, l, s, t) for d, x in tree.items() for l, y in x.items() for s, t in y.items()],
                                   "d string, l string, s string, tokens long")
    for budget in (0, 7, 500, 1500, 4000, 10_000):
        got = mixing.budgets(leaves, ["d", "l", "s"], {"d": weights, "l": weights, "s": weights}, F.lit(budget), 1).collect()
        want = plain_budgets(tree, weights, budget)
        for r in got:
            assert abs(r["budget"] - want[(r["d"], r["l"], r["s"])]) <= 12, (budget, r)
        assert sum(r["budget"] for r in got) <= max(budget, 0)


def test_mixing_cases(spark, make, empty):
    rows = [(i, f"one two three {i}", "en" if i % 3 else None, "src1" if i % 2 else "src2") for i in range(40)]
    rows += [(100, None, "en", "src1"), (101, "", "en", "src1"), (102, "a b", "de", None), (7, "one two three 7", "en", "src1")]
    df = make(rows).withColumn("epoch", F.lit(9)).withColumn("__x", F.lit(1))
    everything = mixing.mix(df, ["lang", "source"], {}, 10_000, epochs=2).collect()
    assert len(everything) == 2 * len(rows) and {r["epoch"] for r in everything} == {0, 1} and {r["__x"] for r in everything} == {1}
    assert mixing.mix(df, ["lang", "source"], {}, 0).collect() == []
    none_of = mixing.mix(df, ["lang", "source"], {"lang": {"en": 0}}, 10_000, epochs=1).collect()
    assert none_of and all(r["lang"] != "en" for r in none_of)
    some = mixing.mix(df, ["lang", "source"], {}, 60, epochs=1)
    a, b = (sorted((r["doc_id"], r["epoch"]) for r in x.collect()) for x in (some, mixing.mix(df.repartition(7), ["lang", "source"], {}, 60, epochs=1)))
    assert a == b and 40 <= some.agg(F.sum("n_tokens")).first()[0] <= 60
    assert mixing.mix(empty, ["lang", "source"], {}, 5).collect() == []
