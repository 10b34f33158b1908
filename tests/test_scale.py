"""Hot groups, copies and blocks: the spread-out routes must equal plain brute force."""

import glob
import random
import statistics
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidymeter.modeling import domain, folds
from tidymeter.operators import pages, payloads, ranks, sequences, similarity as G, wide
from tidymeter.session import LARGE_ROWS, materialize


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, many copies, a null group and an all-null group."""
    rng = random.Random(3)
    rows = [("hot", float(rng.randint(0, 40))) for _ in range(700)]
    rows += [(rng.choice("abcdefgh"), rng.random()) for _ in range(1300)]
    rows += [(None, 1.0), (None, 2.0), ("empty", None), ("one", 5.0)]
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v double, i long")


def test_order_stats_hot_equals_cold(skewed):
    wanted = {"med": ranks.median_rank, "q": ranks.quantile_rank(0.05), "lo": ranks.lower_half_rank,
              "hi": ranks.upper_half_rank, "um": ranks.upper_median_rank}
    extra = {"top": F.max("v"), "mean": F.avg("v")}
    cold = ranks.order_stats(skewed, ["k"], "v", wanted, extra).toPandas().sort_values("k")
    hot = ranks.order_stats(skewed, ["k"], "v", wanted, extra, hot_rows=100).toPandas().sort_values("k")
    assert cold["k"].tolist() == hot["k"].tolist() and cold["n"].tolist() == hot["n"].tolist()
    for c in [*wanted, *extra]:
        assert np.allclose(cold[c], hot[c], equal_nan=True)


def test_iqr_of_halves_against_statistics(skewed):
    got = {r["k"]: r for r in wide.halves_stats(skewed, ["k"], "v", hot_rows=200).collect()}
    groups = {}
    for r in skewed.collect():
        if r["v"] is not None:
            groups.setdefault(r["k"], []).append(r["v"])
    for k, values in groups.items():
        values.sort()
        n = len(values)
        iqr = 0.0 if n < 2 else statistics.median(values[(n + 1) // 2 :]) - statistics.median(values[: n // 2])
        assert got[k]["iqr"] == pytest.approx(iqr) and got[k]["median"] == pytest.approx(statistics.median(values))


def test_exact_rank_hot_equals_window(skewed):
    cold = ranks.exact_rank(skewed, ["k"], ["v", "i"], "r").orderBy("i").toPandas()["r"].tolist()
    hot = ranks.exact_rank(skewed, ["k"], ["v", "i"], "r", hot_rows=50).orderBy("i").toPandas()["r"].tolist()
    assert cold == hot
    whole = ranks.exact_rank(skewed, [], ["v", "i"], "r").toPandas()
    assert sorted(whole["r"]) == list(range(1, skewed.count() + 1))


def test_interleave_with_a_hot_group(skewed):
    cold = [tuple(r) for r in sequences.interleave(skewed, "k", "v", "i").collect()]
    hot = [tuple(r) for r in sequences.interleave(skewed, "k", "v", "i", hot_rows=10).collect()]
    assert sorted(cold, key=str) == sorted(hot, key=str)


def test_hash_rank_is_a_permutation(skewed):
    r = ranks.hash_rank(skewed, ["k"], F.md5(F.col("i").cast("string")), ["i"], "r", digits=1)
    for row in r.groupBy("k").agg(F.count("*").alias("n"), F.max("r").alias("m"), F.countDistinct("r").alias("d")).collect():
        assert row["n"] == row["m"] == row["d"]


def _greedy(sizes, k):
    loads = [0] * k
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return sorted(loads)


@pytest.mark.parametrize("seed", range(4))
def test_group_folds_equal_the_sequential_greedy(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 1, 1, 2, 3, 7, 20]) for _ in range(60)] + [200 * (seed % 2) + 1]
    rows = [(g, i) for g, s in enumerate(sizes) for i in range(s)]
    df = folds.group_folds(spark.createDataFrame(rows, "g int, i int"), "g", folds=4)
    loads = sorted(r["n"] for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect())
    assert loads == _greedy(sizes, 4)
    assert df.groupBy("g").agg(F.countDistinct("fold").alias("d")).agg(F.max("d")).first()[0] == 1


def test_random_folds_are_balanced(spark):
    df = folds.random_folds(spark.range(1003).withColumn("t", F.lit("a")), "id", ["t"])
    sizes = [r["n"] for r in df.groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


@pytest.fixture(scope="module")
def token_rows(spark):
    """Random token sets, near copies, and one text held by a third of the rows."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    base = [rng.sample(words, rng.randint(3, 9)) for _ in range(30)]
    sets = [list(b) for b in base]
    sets += [b[:-1] + [rng.choice(words)] for b in base]
    sets += [base[0]] * 30
    rows = [(i, s) for i, s in enumerate(sets)] + [(900, []), (901, None)]
    return rows, spark.createDataFrame(rows, "id long, tokens array<string>")


def _jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("block", [2, 2000])
def test_neighbors_against_all_pairs(token_rows, monkeypatch, block):
    monkeypatch.setattr(G, "BLOCK_ROWS", block)
    rows, df = token_rows
    first = {}
    for i, s in rows:
        if s:
            first.setdefault(frozenset(s), i)
    ids = {i: s for s, i in first.items()}
    want = {
        (a, b) for a in ids for b in ids if a < b and _jaccard(ids[a], ids[b]) >= 0.6 - 1e-9
    }
    got = {(r["a"], r["b"]) for r in G.neighbors(df, "id", "tokens", 0.4).collect()}
    assert got == want and want


@pytest.mark.parametrize("cutoff", [0.0, 0.2, 0.55, 0.8])
@pytest.mark.parametrize("shared", [1, 3, 50])
def test_neighbors_by_several_shared_tokens(spark, monkeypatch, cutoff, shared):
    monkeypatch.setattr(G, "SHARED", shared)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(45)]
    sets = [rng.sample(words, rng.randint(1, 25)) for _ in range(40)]
    sets += [s[: max(1, len(s) - rng.randint(0, 4))] + rng.sample(words, 2) for s in sets]
    ids = {}
    for i, s in enumerate(sets):
        ids.setdefault(frozenset(s), i)
    ids = {i: s for s, i in ids.items()}
    want = {(a, b) for a in ids for b in ids if a < b and _jaccard(ids[a], ids[b]) >= 1 - cutoff - 1e-9}
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    assert {(r["a"], r["b"]) for r in G.neighbors(df, "id", "tokens", cutoff).collect()} == want


def test_items_are_joined_to_few_pairs(spark, monkeypatch):
    """Sets that share a few rare tokens are told apart by ids; only near ones get their items."""
    sets = [["rare1", "rare2"] + [f"own{i // 2}_{k}" for k in range(28)] + [f"late{i}"] for i in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>")
    written = {}

    def spy(table, name, plain=G.materialize):
        out = plain(table, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(G, "materialize", spy)
    assert {(r["a"], r["b"]) for r in G.neighbors(df, "id", "tokens", 0.4).collect()} == {(i, i + 1) for i in range(0, 60, 2)}
    assert written["near-candidates"] == 30


@pytest.mark.parametrize("rows,tokens,chunk", [(7, 10**9, 1), (100, 60, 40), (20_000, 10**9, 5)])
def test_pairs_stay_in_the_task_of_their_blocks(spark, monkeypatch, rows, tokens, chunk):
    """Sets that share many rare tokens and are not near are told apart where their blocks meet; only near pairs are written."""
    for name, value in (("BLOCK_ROWS", rows), ("BLOCK_TOKENS", tokens), ("CHUNK_PAIRS", chunk), ("CHUNK_CELLS", chunk)):
        monkeypatch.setattr(G, name, value)
    rng = random.Random(4)
    pool = [f"p{i}" for i in range(30)]
    sets = [[f"c{i}" for i in range(10)] + rng.sample(pool, 15) for _ in range(40)]
    sets += [rng.sample(pool, 28) for _ in range(45)]
    ids = {}
    for i, s in enumerate(sets):
        ids.setdefault(frozenset(s), i)
    want = {(a, b): _jaccard(s, t) for s, a in ids.items() for t, b in ids.items() if a < b and _jaccard(s, t) >= 0.6 - 1e-9}
    written = {}

    def spy(table, name, plain=G.materialize):
        out = plain(table, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(G, "materialize", spy)
    df = spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>").repartition(3)
    got = {(r["a"], r["b"]): r["similarity"] for r in G.neighbors(df, "id", "tokens", 0.4).collect()}
    assert got == want and written["near-candidates"] == len(want)


def test_neighbors_of_text_keys(spark):
    """Keys of any kind travel with the blocks; a missing key pairs with nothing."""
    sets = [("b", ["x", "y", "z"]), ("a", ["x", "y", "z", "v"]), (None, ["x", "y", "z", "u"]), ("é", ["x", "y", None, "z"])]
    df = spark.createDataFrame(sets, "id string, tokens array<string>")
    got = {(r["a"], r["b"], r["similarity"]) for r in G.neighbors(df, "id", "tokens", 0.4).collect()}
    assert got == {("a", "b", 0.75), ("b", "é", 0.75), ("a", "é", 0.6)}


def test_members_read_the_rows_once(spark):
    """The rows are cut into tokens once for both sides of the join with their sets."""
    df = spark.createDataFrame([(i, [f"w{i // 2}"]) for i in range(8)], "id long, tokens array<string>")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(tokens):
        seen.add(1)
        return tokens

    rows = df.select("id", cut.asNondeterministic()("tokens").alias("tokens"))
    members = {r["id"]: r["set_id"] for r in G.set_members(rows, "id", "tokens").collect()}
    assert members == {i: i // 2 * 2 for i in range(8)} and seen.value == 8


def test_leader_clusters_against_the_sequential_form(token_rows):
    rows, df = token_rows
    valid = [(i, s) for i, s in rows if s]
    near = {i: [j for j, t in valid if j != i and _jaccard(s, t) >= 0.6 - 1e-9] for i, s in valid}
    label, want = {}, {}
    for i in sorted(near, key=lambda x: (-len(near[x]), x)):
        if i not in label:
            for j in [i, *near[i]]:
                label.setdefault(j, i)
    for i, leader in label.items():
        want.setdefault(leader, set()).add(i)
    got = {}
    labels = G.leader_clusters(df, "id", "tokens", 0.4).collect()
    for r in labels:
        got.setdefault(r["cluster"], set()).add(r["id"])
    assert len(labels) == len(rows)
    invalid = {k for k in got if k.startswith("__invalid_")}
    assert len(invalid) == 2
    assert sorted(map(sorted, (v for k, v in got.items() if k not in invalid))) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("block", [5, 4000])
def test_knn_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(domain, "RING_POINTS", block)
    monkeypatch.setattr(domain, "RING_QUERIES", 3 * block)
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(120, 3)).round(2), np.tile([[1.0, 1.0, 1.0]], (60, 1))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id int, a double, b double, c double")
    distances, threshold = domain.fit_domain(df, ["a", "b", "c"], k=5)
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, 1:6].mean(axis=1)
    got = {tuple(r["v"]): r["mean_distance"] for r in distances.collect()}
    for p, w in zip(points, want):
        assert got[tuple(p)] == pytest.approx(w, abs=1e-9)
    assert threshold.first()["threshold"] == pytest.approx(np.percentile(want, 95))
    new = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 20.0, 20.0, 20.0)], "id int, a double, b double, c double")
    inside = {r["id"]: r["in_domain"] for r in domain.in_domain(df, new, ["a", "b", "c"], threshold.first()["threshold"]).collect()}
    assert inside == {0: True, 1: False}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_all_pairs_and_push_down(spark, sf):
    from tidymeter.catalog import load

    for name in ("c02_dedup_measurements", "c03_summarize", "j04_state_delta", "j08_priority_lookup", "w03_iqr_halves", "b02_assay_level"):
        text = plan(load()[name].run(spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
        assert text.count("Exchange hashpartitioning") == 1 or name == "j04_state_delta", name
    for name in ("m04_random_folds", "m04_random_folds_all", "m05_group_folds", "m06_repeated_group_folds", "m20_scrambled"):
        text = plan(load()[name].run(spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    scan = plan(spark.read.parquet(f"{sf}/lineitem.parquet").where("l_suppkey > 3").groupBy("l_returnflag").agg(F.max("l_tax")))
    assert "GreaterThan(l_suppkey,3)" in scan and "l_extendedprice" not in scan


def test_house_rules():
    root = Path(__file__).resolve().parents[1] / "tidymeter"
    for path in root.rglob("*.py"):
        text = path.read_text()
        for banned in ("localCheckpoint", ".crossJoin(", ".toPandas(", ".rdd.map", "F.udf("):
            assert banned not in text, (path, banned)


def test_empty_splits_do_not_count(spark, monkeypatch):
    """A file with more splits than cores and all rows in one of them is spread by its rows."""
    from functools import reduce

    from tidymeter import session

    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    empty = [spark.range(0)] * spark.sparkContext.defaultParallelism
    df = reduce(lambda a, b: a.union(b), empty, spark.range(0, 400, 1, 1))
    sizes = [r["count"] for r in session.spread_rows(df).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 20


def test_repeated_texts_are_worked_out_once(spark):
    """A header or a JSON value is read once, however many cases look at it."""
    df = spark.createDataFrame([([" Value  (K) ", "Method x", "Boiling  T"], '{"Number":[1,"a"],"Unit":"K"}')], "h array<string>, j string")
    out = df.select(F.transform("h", pages.header_role).alias("roles"), payloads._value_and_unit(F.col("j")).alias("v"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("from_json(") == 1
    row = out.first()
    assert row["roles"] == ["PropertyValue", "Method", "Boiling T"] and tuple(row["v"]) == ("1, a K", "K")


def test_nested_and_unclosed_elements_keep_their_texts():
    page = ("<h2>A <b>head</b></h2><div><p>x = <i>1 &amp; 2<p>y = 2</div><table class='wide data'><tr><th>Q<td/>"
            "<td>a<b> b</b> < c</td><TD title='>'>d</TD></tr></table><table class=data><tr><td>open")
    (found,) = pages._data_tables(page)
    assert (found["heading"], found["equation"]) == ("A head", "y = 2")
    assert found["rows"] == [["", "a b < c", "d"]] and found["headers"] == []


def test_pages_may_have_several_key_columns_and_read_headers_per_table(spark):
    """Keys travel as they are, also null ones, and headers are read before the rows of their table are spread."""
    cell = "<tr><td>a</td><td>1 K</td></tr>"
    page = f"<table class='data'><tr><th>Quantity</th><th>Value</th></tr>{cell * 3}<tr><td> </td><td></td></tr></table>"
    df = spark.createDataFrame([("1", "u", page), (None, None, page), ("2", "v", None)], "CID string, url string, html string")
    tables = pages.data_tables(df, ["CID", "url"])
    assert [(r["CID"], r["url"], r["places"], len(r["body"])) for r in tables.orderBy("CID").collect()] == [(None, None, [1, 2, 3], 3), ("1", "u", [1, 2, 3], 3)]
    rows = pages.extract_html_tables(df, ["CID", "url"]).orderBy("CID", "row_no").collect()
    assert [(r["CID"], r["row_no"], r["PropertyName"], r["PropertyUnit"]) for r in rows] == [(k, n, "a", "K") for k in (None, "1") for n in (1, 2, 3)]


def test_plain_cells_are_one_event_and_read_as_others():
    """A cell with nothing but text is one match; markup inside, slashes and other ends are walked."""
    assert sum(1 for _ in pages._EVENT.finditer("<tr><td>1</td><td a='>'>2 </td ></tr>")) == 4
    page = ("<table class=data><tr><th>Q</th><TH>V = x</TH></tr><tr><td a='/'> 1 </td><td>&lt;</td></tr>"
            "<tr><td/><td><b>2</b> k</td></tr><tr><td>3<td>4</td></tr></table><p>e</p><table class=data><tr><th>H</th></tr></table>")
    first, second = pages._data_tables(page)
    assert first["headers"] == ["Q", "V = x"]
    assert first["rows"] == [["Q", "V = x"], ["1", "<"], ["", "2 k"], ["4"]]
    assert second["equation"] == "V = x"


def test_materialized_tables_are_not_looked_into(spark):
    """The schema is known when a table is written, so that reading it back starts no job."""
    df = spark.createDataFrame([(1, "a")], "id long, `odd.name` string")
    spark.sparkContext.setJobGroup("looking", "")
    try:
        out = materialize(df, "known")
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("looking")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(jobs) == 1 and out.schema == df.schema and [tuple(r) for r in out.collect()] == [(1, "a")]


def test_blocks_of_sets_are_written_one_by_one(spark, monkeypatch):
    """A task that writes many blocks holds one of them, and so does a task that reads them."""
    monkeypatch.setattr(G, "BLOCK_ROWS", 1)
    tokens = F.transform(F.sequence(F.lit(0), F.lit(200_000)), lambda i: F.xxhash64("id", i))
    sets = spark.range(0, 4, 1, 1).select(F.col("id").alias("set_id"), tokens.alias("tokens"))
    shared = spark.sparkContext.broadcast(np.zeros(1 << G.COUNTER_BITS, np.uint64))
    path = materialize(G._blocks(sets, shared), "blocks", **LARGE_ROWS).scratch
    (file,) = glob.glob(f"{path}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [1] * 4
