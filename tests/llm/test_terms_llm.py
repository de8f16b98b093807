import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from termloom.llm import heavy_items, rank_walk
from termloom.llm.distinctive import Models, distinctive_terms, outstanding_terms, parsimonious
from termloom.llm.heavy_items import code_words, decode_word, frequent_items
from termloom.llm.rank_walk import rank_terms
from termloom.llm.top_groups import Clustered, cluster, needed, read_top, top_n_per_group
from termloom.llm.vertical import NAMES, Builder, cardinality, frequencies, layout_of_texts, layout_of_values, marked, numbered, pack, union, united, unpack

NAN = float("nan")


# --- problem 2

def brute_top(rows, n):
    groups = defaultdict(list)
    for g, item, score in rows:
        if None not in (g, item, score) and score == score:
            groups[g].append((-(score + 0.0), item.encode()))
    return {(g, item.decode(), r + 1) for g, found in groups.items() for r, (_, item) in enumerate(sorted(found)[:n])}


def test_top_n_with_a_hot_group_ties_and_dirt(spark):
    rng = random.Random(1)
    rows = [("hot", f"t{rng.randrange(900)}", float(rng.randrange(50))) for _ in range(6000)]
    rows += [(f"g{rng.randrange(300)}", f"é{rng.randrange(40)}", rng.choice([1.0, 2.0, -1.0, 0.0, -0.0])) for _ in range(4000)]
    rows += [(None, "x", 1.0), ("n", None, 1.0), ("n", "x", None), ("n", "x", NAN), ("one", "\U0001f600", -5.0), ("one", "￿", -5.0)]
    df = spark.createDataFrame(rows, "g string, item string, score double").withColumn("rank", F.lit("clash")).withColumn("g0", F.lit(1))
    got = [tuple(r) for r in top_n_per_group(df, ["g"], "item", "score", 5, row_group_rows=100).select("g", "item", "rank").collect()]
    assert set(got) == brute_top(rows, 5) and len(got) == len(set(got))


def files_of(spark, tmp_path, parts, n, rows):
    """Write sorted parts of one-key tables as a clustered set of files; the plan by file."""
    notes = []
    for i, part in enumerate(parts):
        table = pa.table({"g0": [g for g, _, _ in part], "item": [x for _, x, _ in part], "score": [s for _, _, s in part], "sliced": [g == "cut" for g, _, _ in part]})
        file = Clustered(str(tmp_path / f"{i}.parquet"), ["g0"], n, rows)
        file.write(iter(table.to_batches(max_chunksize=70)))
        notes += file.notes
    schema = "uri string, row_group int, whole boolean, top double, max double, nth double, key array<string>"
    rows = [tuple(x[c] for c in ("uri", "row_group", "whole", "top", "max", "nth", "key")) for x in notes]
    return needed(spark.createDataFrame(rows, schema)).collect()


def test_row_groups_below_every_bound_are_not_read(tmp_path, spark):
    rng = np.random.default_rng(2)

    def group(name, n, low, high):
        return [(name, f"i{i:05}", float(s)) for i, s in enumerate(np.sort(rng.uniform(low, high, n))[::-1])]

    # the hot group alone: five of its six row groups are skipped
    plan = files_of(spark, tmp_path, [group("hot", 600, 0, 1)], 5, 100)
    assert [p["needed"] for p in sorted(plan, key=lambda p: p["row_group"])] == [True] + [False] * 5
    # row groups of two large groups each: skipped where both are below their bounds
    plan = files_of(spark, tmp_path, [group("a", 250, 0, 1) + group("b", 250, 5, 6)], 5, 100)
    assert [p["needed"] for p in sorted(plan, key=lambda p: p["row_group"])] == [True, False, True, False, False]
    # a bound found in one file holds in the others
    plan = files_of(spark, tmp_path, [group("cut", 300, 0, 1), group("cut", 300, 2, 3)], 5, 100)
    assert sorted((p["uri"][-9:], p["row_group"]) for p in plan if p["needed"]) == [("1.parquet", 0)]
    # a whole small group keeps its row group
    plan = files_of(spark, tmp_path, [group("a", 150, 0, 1) + group("b", 20, 5, 6) + group("c", 130, 0, 1)], 5, 100)
    assert [p["needed"] for p in sorted(plan, key=lambda p: p["row_group"])] == [True, True, False]
    # equal scores are not strictly below
    plan = files_of(spark, tmp_path, [[("hot", f"i{i:05}", 1.0) for i in range(300)]], 5, 100)
    assert all(p["needed"] for p in plan)


def test_bounds_rise_while_a_file_is_read(tmp_path, spark):
    rows = [("cut", f"i{i:05}", 1.0 - i / 1000) for i in range(500)]
    file = Clustered(str(tmp_path / "x.parquet"), ["g0"], 150, 100)
    file.write(iter(pa.table({"g0": ["cut"] * 500, "item": [r[1] for r in rows], "score": [r[2] for r in rows], "sliced": [True] * 500}).to_batches()))
    plan = [{"row_group": x["row_group"], "whole": x["whole"], "top": x["top"], "beyond": [{"key": x["key"], "max": x["max"], "bound": None}]} for x in file.notes]
    read = [found is not None for _, found in read_top(pq.ParquetFile(str(tmp_path / "x.parquet")), plan, ["g0"], 150)]
    assert read == [True, True, False, False, False]


def test_most_of_the_hot_record_is_skipped(spark):
    rng = random.Random(3)
    rows = [("hot", f"t{i}", rng.random()) for i in range(40_000)] + [(f"g{i // 12}", f"t{i}", rng.random()) for i in range(60_000)]
    df = spark.createDataFrame(pa.table({"g0": [r[0] for r in rows], "item": [r[1] for r in rows], "score": [r[2] for r in rows]}))
    from termloom.sources.tables import spread

    sliced = spread(df, ["g0"], "item").select("g0", "item", "score", (F.col("slices") > 1).alias("sliced")).sortWithinPartitions("g0", F.col("score").desc(), "item")
    plan = needed(cluster(sliced, ["g0"], 5, 1000)).collect()
    hot = [p for p in plan if not p["whole"] and all(b["key"] == ["hot"] for b in p["beyond"])]
    assert len(hot) > 25 and sum(p["needed"] for p in hot) <= 8 and all(p["needed"] for p in plan if p["whole"])
    assert {(r["g0"], r["item"], r["rank"]) for r in top_n_per_group(df, ["g0"], "item", "score", 5).collect()} == brute_top(rows, 5)


def test_top_n_of_the_newest_scores(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), f"t{rng.randrange(300)}", rng.choice([None, NAN, 1.0, 2.0, 3.0, -0.0, 0.0]), rng.choice([None, 1, 2, 3])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, item string, score double, t int").withColumn("at", F.timestamp_seconds("t"))
    best = {}
    for g, item, score, t in rows:
        rank = (-1 if t is None else t, (0, 0.0) if score is None else (2, 0.0) if score != score else (1, score))
        if (g, item) not in best or rank > best[g, item][0]:
            best[g, item] = (rank, score)
    wanted = brute_top([(g, item, s) for (g, item), (_, s) in best.items()], 5)
    assert {(r["g"], r["item"], r["rank"]) for r in top_n_per_group(df, ["g"], "item", "score", 5, "at", 64).collect()} == wanted


def test_top_n_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, item string, score double")
    assert top_n_per_group(empty, ["g"], "item", "score", 5).collect() == []


# --- problem 3

def test_em_converges_to_its_fixed_point():
    rng = np.random.default_rng(0)
    for own in (0.1, 0.5, 0.9):
        sizes = [1, 2, 40, 7]
        starts = np.cumsum([0, *sizes[:-1]])
        n = rng.integers(1, 30, sum(sizes)).astype(float)
        q = rng.random(sum(sizes)) ** 4 / 10
        t = rng.integers(1, 4, sum(sizes)).astype(float)
        converged, z = parsimonious(starts, n, q, t, own)
        odds = (1 - own) / own
        for s, k, zz in zip(starts, sizes, z):
            part = slice(s, s + k)
            p = n[part] / (n[part] * t[part]).sum()
            for _ in range(30_000):
                e = n[part] * p / (odds * q[part] + p)
                p = e / (e * t[part]).sum()
            assert np.allclose(p, converged[part], atol=1e-4) and math.isclose((converged[part] * t[part]).sum(), 1.0)
            assert np.allclose(p, np.maximum(0, n[part] / zz - odds * q[part]), atol=1e-4)


def chunk_of(rows, records, pairs):
    docs, freq, df, times = zip(*rows)
    return pa.table({"doc_id": docs, "freq": freq, "df": df, "times": times, "records": [float(records)] * len(rows), "pairs": [float(pairs)] * len(rows)})


def test_the_model_leads_to_the_outstanding_terms():
    # a term of every record has the greatest count of each; only EM takes its mass away
    rng = np.random.default_rng(12)
    rows, wanted = [], 0
    for d in range(300):
        rows.append((f"d{d:03}", 35, 300, 1))
        rows.append((f"d{d:03}", 30, 1, 1))
        rows += [(f"d{d:03}", int(f), int(k), 1) for f, k in zip(rng.integers(1, 4, 20), rng.integers(2, 200, 20))]
        wanted += 1
    rows.sort(key=lambda r: r[0])
    chunk = chunk_of(rows, 300, 300 * 22)

    def first_of_model(steps):
        models = Models(chunk, 0.1, steps)
        owner = np.repeat(np.arange(300), models.lengths)
        first = np.lexsort((-models.p, owner))[models.starts]
        return int(sum(models.df[first] == 1))

    assert first_of_model(1000) == wanted and first_of_model(0) == 0
    assert len(Models(chunk, 0.1, 1000).outstanding(2.03)) == wanted


def test_the_walk_down_the_model_ends_early_and_misses_nothing(monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(f"d{d:03}", int(f), int(k), int(t)) for d in range(400) for f, k, t in zip(rng.pareto(0.8, 30).astype(int) + 1, rng.integers(1, 90, 30) ** 2 // 20 + 1, rng.integers(1, 3, 30))]
    chunk = chunk_of(rows, 400, 400 * 45)
    models = Models(chunk, 0.1, 1000)
    got = set(models.outstanding(2.03).tolist())
    whole = set()
    for s, k in zip(models.starts, models.lengths):
        part = np.arange(s, s + k)
        weight = models.freq[part] / (models.freq[part] * models.times[part]).sum() * np.log(400 / (1 + models.df[part]))
        top = int(weight.argmax())
        others = np.delete(weight, top).max() if models.times[part[top]] == 1 else weight[top]
        if weight[top] > 0 and weight[top] >= 2.03 * others:
            whole.add(int(part[top]))
    assert got == whole and len(whole) > 20


def brute_outstanding(rows, ratio=2.03):
    pairs = {(d, t): f for d, t, f in rows if d is not None and t is not None}
    docs = defaultdict(dict)
    for (d, t), f in pairs.items():
        docs[d][t] = f
    df = Counter(t for d, t in pairs)
    out = set()
    for d, own in docs.items():
        total = sum(own.values())
        w = {t: f / total * math.log(len(docs) / (1 + df[t])) for t, f in own.items()}
        for t in own:
            if len(own) > 1 and w[t] > 0 and all(w[t] >= ratio * v for o, v in w.items() if o != t):
                out.add((d, t))
    return out


def test_outstanding_terms(spark):
    rng = random.Random(4)
    freq = {}
    rows = []
    for _ in range(4000):
        d, t = f"d{min(rng.randrange(120), rng.randrange(120))}", f"t{int(rng.paretovariate(0.6)) % 400}"
        rows.append((d, t, freq.setdefault((d, t), int(rng.paretovariate(0.8)) % 60 + 1)))
    rows += [(None, "t1", 3), ("d1", None, 3), ("lone", "only", 9), ("twin", "a", 5), ("twin", "b", 5)]
    df = spark.createDataFrame(rows, "doc_id string, term string, freq int").withColumn("df", F.lit(7)).withColumn("z", F.lit(7))
    wanted = brute_outstanding(rows)
    assert len(wanted) > 5 and {tuple(r) for r in outstanding_terms(df).collect()} == wanted
    scores = distinctive_terms(df).collect()
    assert len(scores) == len({(d, t) for d, t, _ in rows if d and t})
    sums = defaultdict(float)
    for r in scores:
        sums[r["doc_id"]] += r["score"]
    assert all(math.isclose(s, 1.0, abs_tol=1e-9) for s in sums.values())


def test_distinctive_edges(spark):
    schema = "doc_id string, term string, freq int"
    assert distinctive_terms(spark.createDataFrame([], schema)).collect() == []
    rows = distinctive_terms(spark.createDataFrame([("a", "x", None), ("a", "y", -3), ("b", "x", 2), ("b", "x", 2)], schema)).collect()
    assert {(r["doc_id"], r["term"]): r["score"] for r in rows} == {("a", "x"): 0.0, ("a", "y"): 0.0, ("b", "x"): 1.0}


# --- problem 4

def test_code_corrects_two_symbols():
    rng = np.random.default_rng(5)
    for value in rng.integers(0, heavy_items.MASK, 60):
        word = code_words(np.array([value]))[0]
        assert decode_word(word) == value
        for wrong in (1, 2):
            bad = word.copy()
            for at in rng.choice(15, wrong, replace=False):
                bad[at] ^= rng.integers(1, 16)
            assert decode_word(bad) == value


def test_frequent_items(spark):
    rng = random.Random(6)
    items = [f"h{i}" for i in range(150) for _ in range(200)] + [f"r{rng.randrange(10**9)}" for _ in range(9000)] + [None] * 500 + [""] * 400
    rng.shuffle(items)
    df = spark.createDataFrame([(x,) for x in items], "term string").withColumn("print", F.lit(1)).repartition(5)
    counts = Counter(x for x in items if x is not None)
    total = sum(counts.values())
    for share in (0.005, 0.2):
        got = {r["term"]: r["n_rows"] for r in frequent_items(df, "term", share).collect()}
        assert got == {t: n for t, n in counts.items() if n >= share * total}
    assert frequent_items(spark.createDataFrame([(None,)], "term string"), "term").collect() == []
    assert frequent_items(spark.createDataFrame([], "term string"), "term").collect() == []


def test_small_shares_get_more_groups_or_an_error(spark):
    items = [f"h{i}" for i in range(900) for _ in range(20)] + [f"r{i}" for i in range(2000)]
    df = spark.createDataFrame([(x,) for x in items], "term string")
    got = {r["term"]: r["n_rows"] for r in frequent_items(df, "term", 0.0009).collect()}
    assert got == {f"h{i}": 20 for i in range(900)}
    assert heavy_items.groups_for(0.005) == 1024 and heavy_items.groups_for(0.0009) > 4096
    for share in (1e-5, 0.0):
        with pytest.raises(ValueError):
            frequent_items(df, "term", share)


def test_what_is_left_in_a_group_is_bounded():
    rng = np.random.default_rng(15)
    sketch = np.zeros((heavy_items.REPEATS, 4, heavy_items.LENGTH, heavy_items.SYMBOLS), dtype=np.int64)
    prints = np.repeat(rng.integers(0, heavy_items.MASK, 60), rng.integers(1, 200, 60))
    heavy_items.add_to_sketch(sketch, prints)
    counts = Counter(prints.tolist())
    for r in range(heavy_items.REPEATS):
        for g in range(4):
            found, bound = heavy_items.decode_group(sketch[r, g], r, g, 4)
            others = [n for v, n in counts.items() if v not in found and heavy_items.group_of(np.array([v]), r, 4)[0] == g]
            assert bound >= max(others, default=0)
            known = {v: n for v, n in counts.items() if v not in found and heavy_items.group_of(np.array([v]), r, 4)[0] == g}
            assert heavy_items.decode_group(sketch[r, g], r, g, 4, known)[1] <= bound


def test_collisions_are_hashed_anew(spark, monkeypatch):
    df = spark.createDataFrame([(f"h{i % 3}",) for i in range(300)], "term string")
    real, rounds = heavy_items.decoded, []

    def blind(prints, groups, first=0):
        rounds.append(first)
        cells = real(prints, groups, first)
        return cells if first else cells.withColumn("found", F.create_map().cast("map<bigint,bigint>")).withColumn("bound", F.col("total")).withColumn("counters", F.lit(np.tile(np.array([150, 150] + [0] * 14), 15).tobytes()))

    monkeypatch.setattr(heavy_items, "decoded", blind)
    wide = spark.createDataFrame([(f"h{i % 3}",) for i in range(300)], "term string")
    assert {r["term"] for r in frequent_items(wide, "term", 0.2).collect()} == {"h0", "h1", "h2"} and rounds == [0, heavy_items.REPEATS] and df.count() == 300


# --- problem 6

def test_containers():
    rng = np.random.default_rng(7)
    for a, b in ((3, 5), (5000, 10), (40000, 30000), (0, 4)):
        x, y = (np.sort(rng.choice(65536, k, replace=False)) for k in (a, b))
        assert unpack(pack(x)).tolist() == x.tolist() and cardinality(pack(x)) == a
        both = union(pack(x), pack(y))
        assert unpack(both).tolist() == sorted({*x.tolist(), *y.tolist()}) and cardinality(both) == len({*x.tolist(), *y.tolist()})


def test_containers_of_a_batch_are_united():
    rng = np.random.default_rng(8)
    rows, wanted = [], {}
    for item, key, sizes in (("a", 0, (3, 5, 9)), ("a", 1, (5000, 10)), ("b", 0, (1,)), ("b", 7, (3000, 3000)), ("c", 0, (40000, 6000, 2)), ("d", 2, (0, 4))):
        for k in sizes:
            numbers = np.sort(rng.choice(65536, k, replace=False))
            rows.append((item, key, k + 1, k, pack(numbers)))
            wanted.setdefault((item, key), [0, set()])
            wanted[item, key][0] += k + 1
            wanted[item, key][1] |= set(numbers.tolist())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=NAMES)
    for part in (batch, batch.slice(2), batch.slice(0, 3)):
        for r in united(part).to_pylist():
            assert r["records"] == cardinality(r["container"]) == len(unpack(r["container"]))
    got = {(r["item"], r["container_key"]): [r["occurrences"], set(unpack(r["container"]).tolist())] for r in united(batch).to_pylist()}
    assert got == wanted


def test_builder_holds_no_more_than_its_limit():
    builder, rng = Builder(1000), np.random.default_rng(9)
    counts, where, most = Counter(), defaultdict(set), 0
    batches = []
    for _ in range(50):
        local, numbers = rng.integers(0, 30, 300), rng.integers(0, 300_000, 300)
        for i, n in zip(local.tolist(), numbers.tolist()):
            counts[f"w{i}"] += 1
            where[f"w{i}"].add(n)
        batches += list(builder.add([f"w{i}" for i in range(30)], local, numbers))
        most = max(most, builder.size)
    batches += list(builder.flush())
    assert most < 1300 and builder.size == 0 and len(batches) > 10
    got = defaultdict(set)
    occurrences = Counter()
    for r in (r for b in batches for r in b.to_pylist()):
        got[r["item"]] |= {(r["container_key"] << 16) + n for n in unpack(r["container"]).tolist()}
        occurrences[r["item"]] += r["occurrences"]
    assert got == where and occurrences == counts


@pytest.mark.parametrize("pairs", [1 << 21, 50])
def test_frequencies(spark, pairs):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("a b c d_1 Été x2 中文 ½".split()) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "", "  ", "A" * 5000]
    wanted = Counter(w for t in texts for w in (t or "").lower().split())
    where = {w: sum(w in (t or "").lower().split() for t in texts) for w in wanted}
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "record string, text string").withColumn("item", F.lit(1)).repartition(3)
    numbers = numbered(df, "record")
    assert sorted(r["number"] for r in numbers.collect()) == list(range(len(texts)))
    rows = {r["item"]: (r["occurrences"], r["records"]) for r in frequencies(layout_of_texts(df, numbers, pairs=pairs)).collect()}
    assert rows == {w: (n, where[w]) for w, n in wanted.items()}


def test_a_record_seen_by_several_tasks_counts_once(spark):
    df = spark.createDataFrame([("hot", "x")] * 40 + [("r", "x"), ("r", "y")], "record string, item string").repartition(7)
    numbers = numbered(df, "record")
    broadcast = layout_of_values(df, F.broadcast(numbers), 5)  # the rows stay in their seven tasks
    assert {r["item"]: (r["occurrences"], r["records"]) for r in frequencies(broadcast).collect()} == {"x": (41, 2), "y": (1, 1)}
    assert broadcast.count() == 2  # one container for each item once united


def test_value_frequencies_with_a_hot_record_and_marks(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.4 else f"d{rng.randrange(30)}", f"t{int(rng.paretovariate(0.7)) % 60}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "record string, item string").withColumn("part", F.lit("x"))
    got = {r["item"]: r for r in marked(frequencies(layout_of_values(df, numbered(df, "record"), 100)), df.agg(F.count_distinct("record").alias("n_records"))).collect()}
    records = defaultdict(set)
    for d, t in rows:
        records[t].add(d)
    n = len({d for d, _ in rows})
    assert {t: (r["occurrences"], r["records"]) for t, r in got.items()} == {t: (c, len(records[t])) for t, c in Counter(t for _, t in rows).items()}
    assert {t: r["mark"] for t, r in got.items()} == {t: "rare" if len(s) <= 1 else "common" if len(s) > 0.42 * n else None for t, s in records.items()}
    for layout, columns in ((layout_of_values, "record string, item string"), (layout_of_texts, "record string, text string")):
        empty = spark.createDataFrame([], columns)
        assert frequencies(layout(empty, numbered(empty, "record"))).collect() == []


def test_outstanding_term_of_the_background(spark):
    rows = [("hot", t, 1000) for t in "xyz"] + [("r", "x", 40)] + [("r", f"rare{i}", 1) for i in range(60)] + [(f"d{i}", f"only{i}", 1) for i in range(200)]
    assert [tuple(r) for r in outstanding_terms(spark.createDataFrame(rows, "doc_id string, term string, freq int")).collect()] == [("r", "x")]


# --- problem 7

def brute_walk(rows, damping=rank_walk.DAMPING, steps=60):
    scores = defaultdict(dict)
    for _, s, t, v in rows:
        scores[s][t] = v
    items = sorted({t for _, _, t, _ in rows})
    own = {t: [s for s in scores if t in scores[s]] for t in items}
    before = p = {t: 1 / len(items) for t in items}
    for _ in range(steps):
        nxt = {t: (1 - damping) / len(items) for t in items}
        for t in items:
            for s in own[t]:
                up = [u for u, v in scores[s].items() if v > scores[s][t]] or [t]
                for u in up:
                    nxt[u] += damping * p[t] / len(own[t]) / len(up)
        before, p = p, nxt
    weight = {t: (p[t] - damping * before[t]) / (1 - damping) for t in items}
    beats = lambda a, b: sum((scores[s][a] > scores[s][b]) - (scores[s][a] < scores[s][b]) for s in scores if a in scores[s] and b in scores[s]) > 0
    winner = [a for a in items if all(beats(a, b) for b in items if b != a)]
    return weight, winner


@pytest.mark.parametrize("shares", [0.01, 1, 10**6])
def test_rank_walk(spark, shares, monkeypatch):
    monkeypatch.setattr(rank_walk, "ENTRIES", 20)
    # shares: no record, some, or every record is cut into blocks
    rng = random.Random(10)
    rows = []
    for d in range(6):
        for s in ("w", "x", "y", "z")[: rng.randrange(1, 5) if d else 4]:
            for t in range(20 if d % 2 == 0 else 5):
                if rng.random() < 0.8:
                    rows.append((f"d{d}", s, f"t{t}", float(rng.randrange(6)) * (1000 if s == "x" else -1 if s == "y" else 1)))
    dirt = [(None, "w", "t", 1.0), ("d0", None, "t", 1.0), ("d0", "w", None, 1.0), ("d0", "w", "q", None), ("d0", "w", "r", NAN)]
    df = spark.createDataFrame(rows + dirt, "doc_id string, scorer string, term string, score double").withColumn("weight", F.lit(1))
    got = defaultdict(dict)
    for r in rank_terms(df, shares=shares, few=0).collect():
        got[r["doc_id"]][r["term"]] = r
    for d in {r[0] for r in rows}:
        weight, winner = brute_walk([r for r in rows if r[0] == d])
        assert got[d].keys() == weight.keys()
        assert all(math.isclose(got[d][t]["weight"], w, abs_tol=1e-9) for t, w in weight.items())
        assert [t for t, r in got[d].items() if r["winner"]] == winner
        order = sorted(weight, key=lambda t: (-round(got[d][t]["weight"], rank_walk.DIGITS), t))
        assert [got[d][t]["place"] for t in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("shares", [0.01, 4])
def test_rank_walk_of_many_terms_keeps_different_weights_apart(spark, shares):
    n = 30_000
    scores = np.random.default_rng(11).permuted(np.tile(np.arange(n), (4, 1)), axis=1)
    df = spark.createDataFrame(pa.table({"doc_id": ["d"] * 4 * n, "scorer": np.repeat(list("wxyz"), n), "term": [f"t{i:05}" for i in range(n)] * 4, "score": scores.ravel().astype(float)}))
    got = rank_terms(df, shares=shares, few=0).select("weight", "place").orderBy("place").toPandas()
    weight = got["weight"].to_numpy()
    assert got["place"].tolist() == list(range(1, n + 1))
    assert len(np.unique(np.round(weight, rank_walk.DIGITS))) < len(np.unique(weight))
    assert (weight[1:] <= weight[:-1] * (1 + 1e-11)).all()


def test_rounded_weights_are_those_of_the_tables(spark):
    weight = np.concatenate([2.0 ** -np.arange(1.0, 40), np.random.default_rng(1).random(500) ** 8, [0.0, -1e-9, 1e-30]])
    df = spark.createDataFrame(pa.table({"w": weight, "n": np.full(len(weight), 1000)}))
    assert df.select(rank_walk.comparable_column("w", "n")).toPandas().iloc[:, 0].tolist() == rank_walk.comparable(weight, np.full(len(weight), 1000)).tolist()
    tops = rank_walk.comparable(1e-6 * (1 + np.array([0.0, 1e-15, 1e-10])), np.full(3, 1_000_000))
    assert tops[0] == tops[1] < tops[2]


def test_the_walk_puts_winners_first():
    rng = np.random.default_rng(14)
    n, k = 400, 12
    quality = rng.random((n, k))
    score = (quality[:, None, :] + 0.15 * rng.random((n, 4, k))).ravel()
    doc, scorer, term = np.repeat(np.arange(n), 4 * k), np.tile(np.repeat(np.arange(4), k), n), np.tile(np.arange(k), 4 * n)
    w = rank_walk.Walk(doc, term, scorer, score)
    of = np.repeat(np.arange(n), w.doc_size)

    def first_places(most):
        order = np.lexsort((-w.stationary(most=most), w.item_doc))
        won = w.winners(order)
        return won, int(won[order[w.doc_start]].sum())

    won, first = first_places(200)
    same, chance = first_places(0)
    assert (won == same).all() and len(of) == n * k
    assert won.sum() > 300 and first >= 0.95 * won.sum() and chance < 0.3 * won.sum()


def test_rank_walk_of_nothing(spark):
    assert rank_terms(spark.createDataFrame([], "doc_id string, scorer string, term string, score double")).collect() == []
