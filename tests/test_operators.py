import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import abtest, boost, crawl, index, metrics, network, prefix, rank, shingles
from tessera.plans import boolean, rank_queries
from tessera.sources import files, records


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for k in range(1, 60)] + [(60, None), (61, ""), (70000, "w1 w2")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").cache()


QUERIES = ["w1 & w2", "w1 | w2 & !w3", "!(w1 | w2)", "w1 w2", "unknown", "!unknown & w4", "((w1))", "w1 & (w2 | (w3 & !w4)) | w5"]


def brute(docs, query):
    tree = boolean.parse(query)
    return {r.doc_id for r in docs.collect() if boolean.holds(tree, set((r.text or "").split()))}


def test_boolean_plans_match_brute_force(spark, docs):
    terms, universe = index.doc_terms(docs), docs.select(F.col("doc_id").alias("key"))
    for q in QUERIES:
        found = [r.key for r in index.search(terms, universe, q).collect()]
        assert len(found) == len(set(found)) and set(found) == brute(docs, q), q


def test_many_queries_at_once(spark, docs):
    terms, universe = index.doc_terms(docs), docs.select(F.col("doc_id").alias("key"))
    asked = spark.createDataFrame([*enumerate(QUERIES), (90, "(w1"), (91, None), (92, "w1 & | w2")], "query_id bigint, query string")
    found = {}
    for r in index.search_many(asked, terms, universe).collect():
        found.setdefault(r.query_id, []).append(r.key)
    counts = {r.query_id: r.n_results for r in index.search_many(asked, terms, universe, counts_only=True).collect()}
    for k, q in enumerate(QUERIES):
        want = brute(docs, q)
        assert sorted(found.get(k, [])) == sorted(want) and counts[k] == len(want), q
    assert not {90, 91, 92} & set(counts)


def test_queries_of_many_terms(spark, docs):
    terms, universe = index.doc_terms(docs), docs.select(F.col("doc_id").alias("key"))
    none = " | ".join(f"zz{k}" for k in range(14))
    long = " | ".join(f"zz{k}" for k in range(2000))
    asked = [f"w1 | {none}", f"(w1 & !w2) | {none}", f"!(w1 | {none})", f"w1 & !({long})", f"{long} | w2 & w3", "w1 | w2"]
    queries = spark.createDataFrame([*enumerate(asked), (90, f"({none} | w1 | w2")], "query_id bigint, query string")
    found = {}
    for r in index.search_many(queries, terms, universe).collect():
        found.setdefault(r.query_id, []).append(r.key)
    counts = {r.query_id: r.n_results for r in index.search_many(queries, terms, universe, counts_only=True).collect()}
    texts = {r.doc_id: set((r.text or "").split()) for r in docs.collect()}
    tests = [lambda w: "w1" in w, lambda w: "w1" in w and "w2" not in w, lambda w: "w1" not in w, lambda w: "w1" in w, lambda w: {"w2", "w3"} <= w, lambda w: bool({"w1", "w2"} & w)]
    for k, test in enumerate(tests):
        want = sorted(key for key, w in texts.items() if test(w))
        assert want and sorted(found.get(k, [])) == want and counts[k] == len(want), asked[k][:30]
    assert set(counts) == set(range(len(asked)))


@pytest.mark.parametrize("bad", ["(a", "a)", "a &", "| b", "!", ""])
def test_queries_that_are_none(bad):
    with pytest.raises(boolean.QueryError):
        boolean.parse(bad)


def test_stored_index_round_trip(spark, docs, tmp_path):
    for codec in ("varbyte", "simple9"):
        path = str(tmp_path / codec)
        index.store(docs, path, codec)
        stored = {(r.term, r.key) for r in index.load(spark, path).collect()}
        assert stored == {(r.term, r.key) for r in index.doc_terms(docs).collect()}
    assert {r.block for r in index.postings(docs).collect()} == {0, 1}


def test_sketch_pairs_match_brute_force(spark):
    rng = random.Random(1)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(14):
        words = list(base)
        for _ in range(k % 5):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((f"u{k:02}", " ".join(words)))
    rows += [("z1", "too short"), ("z2", None), ("z3", ""), ("z4", "a b c d e f")]
    df = spark.createDataFrame(rows, "url string, text string")
    sketched = shingles.sketches(df, "url")
    sets = {r.key: set(r.sketch) for r in sketched.collect()}
    assert all(len(s) == 20 for s in sets.values()) and not {"z1", "z2", "z3", "z4"} & set(sets)
    reps = {r.key: r.rep for r in shingles.classes(sketched).collect()}
    assert set(reps) == set(sets) and all(sets[k] == sets[v] and v <= k for k, v in reps.items())
    got = {(r.key1, r.key2): r.shared for r in shingles.pairs(sketched, 18).collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(set(reps.values())), 2) if len(sets[a] & sets[b]) >= 18}
    assert got == want


def test_running_sums_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), k, rng.randint(0, 9) if k % 7 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
    got = {(r.g, r.o): (r.s, r.row) for r in prefix.running_sums(df, ["g"], [F.col("o")], {"s": "v", "row": "1"}).collect()}
    sums = {"a": [0, 0], "b": [0, 0]}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        sums[g] = [sums[g][0] + (v or 0), sums[g][1] + 1]
        assert got[g, o] == tuple(sums[g])
    assert prefix.row_numbers(df.limit(0), ["g"], [F.col("o")]).count() == 0


def test_metrics(spark):
    rows = [(True, 0.9), (True, 0.4), (False, 0.4), (False, 0.1), (True, None), (None, 0.3)]
    df = spark.createDataFrame(rows, "label boolean, score double")
    c = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in metrics.confusion(df, [0.0, 0.4, 1.0]).collect()}
    assert c == {0.0: (2, 2, 0, 0), 0.4: (1, 0, 1, 2), 1.0: (0, 0, 2, 2)}
    assert metrics.roc_auc(df).first().auc == 0.875
    assert metrics.confusion(df.limit(0), [0.5]).first()[1:] == (0, 0, 0, 0)
    r = metrics.precision_recall(metrics.confusion(df, [0.4])).first()
    assert (r.precision, r.recall, r.f1) == (1.0, 0.5, round(2 / 3, 6))


def brute_split(x, y, min_leaf=1):
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[:, f]):
            left = x[:, f] < v
            nl, nr = left.sum(), (~left).sum()
            if nl >= min_leaf and nr > min_leaf:
                gain = y.var() - (nl * y[left].var() + nr * y[~left].var()) / len(y)
                if best is None or round(gain, 9) > best[2]:
                    best = (f, v, round(gain, 9))
    return best


def design(spark, x, y):
    return spark.createDataFrame([(k, list(map(float, a)), float(b)) for k, (a, b) in enumerate(zip(x, y))], "row bigint, x array<double>, y double")


def test_best_split_matches_brute_force(spark):
    x, y = np.array([[1, 0, 5], [2, 3, 5], [2, 3, 4], [2, 9, 1], [2, 9, 4], [1, 2, 1]]), np.array([1, 0, 3, 6, 4, 1])
    got = boost.best_splits(boost.split_gains(design(spark, x, y).withColumn("g", F.lit(0)), ["g"]), ["g"]).first()
    f, v, gain = brute_split(x, y)
    assert (got.feature, got.value) == (f, v) and abs(got.gain - gain) < 1e-6


def grow(x, y, depth):
    split = brute_split(x, y) if depth else None
    if not split or split[2] <= 0:
        return y.mean()
    left = x[:, split[0]] < split[1]
    return split[0], split[1], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def apply(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def test_trees_and_boosting(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 2) + rng.normal(0, 0.1, 60)
    rows = design(spark, x, y)
    one = boost.fit(rows, 3, steps=1, depth=2)
    got = {r.row: r.prediction for r in one.predict(rows).collect()}
    tree = grow(x, y, 2)
    assert all(abs(got[k] - apply(tree, x[k])) < 1e-9 for k in got)
    errors = [r.mse for r in boost.curve(boost.fit(rows, 3, steps=3, depth=2, shrinkage=0.5), rows).orderBy("steps").collect()]
    assert errors == sorted(errors, reverse=True)
    bagged = boost.fit(rows, 3, steps=1, depth=2, bags=2, row_share=0.8, column_share=0.67)
    assert {f for (b, _), s in bagged.splits.items() for f, _ in s.values() if f not in bagged.columns[b]} == set()
    drawn = boost.fit(rows, 3, steps=1, depth=2, bags=2, replace=True)
    assert len(drawn.leaves) == 2 and drawn.leaves[0, 0] != drawn.leaves[1, 0]
    flat = boost.fit(rows, 3, steps=1, depth=2, oblivious=True)
    level = {flat.splits[0, 0].get(n) for n in (2, 3)}
    assert len(level) == 1


def test_ranking(spark):
    docs = spark.createDataFrame([(1, "a b c a", "b"), (2, "x y", None), (3, None, "a")], "doc_id bigint, text string, title string")
    asked = spark.createDataFrame([(1, "a c"), (2, "zzz 1999"), (3, None)], "query_id bigint, query string")
    clicks = spark.createDataFrame([(1, [1, 2, 9], [2]), (1, [1], None), (2, [3], []), (3, [], None), (3, [1], [1])], "query_id bigint, serp array<bigint>, clicked array<bigint>")
    shown = {(r.query_id, r.doc_id): r.clicked for r in rank.shown(clicks).collect()}
    assert shown == {(1, 1): 0, (1, 2): 1, (1, 9): 0, (2, 3): 0, (3, 1): 1}
    places = spark.createDataFrame([("c",)], "term string")
    keywords = spark.createDataFrame([(1, "c"), (2, "zzz")], "query_id bigint, keyword string")
    f = {(r.query_id, r.doc_id): r for r in rank.text_features(rank.shown(clicks), asked, docs, places, keywords).collect()}
    assert (f[1, 1].part_key_text, f[1, 1].all_key_title, f[2, 3].all_key_text, f[1, 1].len_text, f[1, 1].first_pos_title) == (1.0, 0, 0, 4, rank.NOWHERE)
    assert (1, 9) not in f
    assert (f[1, 1].first_pos_text, f[1, 1].min_dist_text, f[1, 1].part_text, f[1, 1].all_text, f[1, 1].phrase_text, f[1, 1].geo_text) == (0, 1, 1.0, 1, 0, 1)
    assert f[1, 2].first_pos_text == rank.NOWHERE and f[3, 1].part_text == 0 and f[2, 3].year_text == 0
    base = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.5)], "query_id bigint, doc_id bigint, score double")
    extra = spark.createDataFrame([(1, 3, 2.0, 1), (1, 7, 1.0, 0)], "query_id bigint, doc_id bigint, score double, replaced int")
    merged = {r.doc_id: round(r.score, 4) for r in rank.merge_variants(base, extra).collect()}
    assert merged == {1: 1.0, 2: 1.0, 3: 2.48, 7: 1.0}
    assert [(r.doc_id, r.place) for r in rank.top_k(base, 2).orderBy("place").collect()] == [(1, 1), (2, 2)]
    synonyms = spark.createDataFrame([("a", "b", 0.9), ("a", "d", 0.85), ("a", "e", 0.1), ("1999", "2000", 0.99)], "term string, synonym string, sim double")
    variants = [(r.query, r.replaced) for r in rank.query_variants(asked.filter("query_id = 1"), synonyms).orderBy("variant").collect()]
    assert variants == [("a c", 0), ("b c", 1), ("d c", 1)]
    grown = {r.query_id: r.query for r in rank.expand_queries(asked, synonyms, top=1, stop=("c",)).collect()}
    assert grown == {1: "a c b", 2: "zzz 1999 2000", 3: ""}
    assert {r.term: r.tf for r in rank.term_counts(docs, "doc_id", "text").filter("doc_id = 1").collect()} == {"a": 2, "b": 1, "c": 1}
    assert {r.term: r.tf for r in rank.term_counts(docs, "doc_id", "text", pairs=True).filter("doc_id = 1").collect()} == {"a b": 1, "b c": 1, "c a": 1}
    scaled = rank.min_max(base, "query_id", ["score"]).collect()
    assert sorted(r.score for r in scaled) == [0.0, 1.0, 1.0]


def test_nearest_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 6))
    rows = [(k, list(map(float, v))) for k, v in enumerate(x)] + [(100, None), (101, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in rank.nearest(df, df.filter("vec_id % 10 = 0"), 3, chunk=7).collect():
        got.setdefault(r.query_vec, {})[r.place] = r.vec_id
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in range(0, 80, 10):
        order = [k for k in np.argsort(-np.round(unit @ unit[q], 6), kind="stable") if k != q][:3]
        assert [got[q][p] for p in (1, 2, 3)] == order


def test_ab(spark):
    rows = [(k, "A " if k % 2 else "b-1", [k % 3, 1] if k % 5 else None) for k in range(400)] + [(900, None, [1]), (901, "a", [])]
    df = spark.createDataFrame(rows, "session_id bigint, split_name string, clicks array<int>")
    groups = abtest.group_metrics(df, 20)
    kept = {}
    for k, s, c in rows:
        if s and c:
            kept.setdefault(s.strip().replace("-", "").lower(), []).append((float(sum(c) > 0), sum(c) / len(c)))
    want = {(s, g): np.mean(v[g * 20 : g * 20 + 20], axis=0) for s, v in kept.items() for g in range(len(v) // 20)}
    got = {(r.split, r.grp): (r.ctr, r.mean_clicks) for r in groups.collect()}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    t = abtest.t_criterion(groups, "a", "b1", "mean_clicks").first()
    a, b = ([v[1] for k, v in want.items() if k[0] == s] for s in ("a", "b1"))
    assert abs(t.t - abs(np.mean(a) - np.mean(b)) / np.sqrt(np.var(a, ddof=1) / len(a) + np.var(b, ddof=1) / len(b))) < 1e-5
    asl = abtest.bootstrap(groups, "a", "b1", "mean_clicks", 200).first().asl
    assert 0 <= asl <= 1


def test_admission_replay_and_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(2)}", k, rng.randrange(4)) for k in range(300)]
    df = spark.createDataFrame(rows, "site string, rec_id bigint, cluster bigint")
    quality = crawl.cluster_quality(df.withColumn("is_good", F.col("cluster") + F.col("rec_id") % 3 > 3), 60)
    ranked = crawl.cumulative_share(quality).orderBy(F.desc("ratio"), "cluster").collect()
    ratios, cum, shares = [r.ratio for r in ranked], [r.cum_share for r in ranked], [r.share for r in ranked]
    by = {r.cluster: r.ratio for r in ranked}
    want = {}
    for site in ("s0", "s1"):
        gate = crawl.Admission(ratios, cum, shares, 60)
        want.update({k: gate.fetch(by[c]) for s, k, c in rows if s == site})
        assert gate.used <= 60
    assert {r.rec_id: r.fetched for r in crawl.replay(df, quality, 60).collect()} == want

    from tessera.streaming import admission

    for part in range(3):
        df.filter((F.col("rec_id") >= part * 100) & (F.col("rec_id") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("site string, rec_id bigint, cluster bigint").parquet(str(tmp_path / "in"))
        out = admission.admit(stream, ratios, cum, shares, by, 60)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r.rec_id: r.fetched for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_network_learns(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (120, 6)).astype(float)
    y = (x[:, 0] + x[:, 1] > 1).astype(float)
    rows = design(spark, x, y)
    machine = network.Rbm(6, 4)
    before = machine.reconstruction_error(rows)
    assert machine.fit(rows, epochs=5, share=1.0).reconstruction_error(rows) < before + 1e-9
    net = network.Network([6, 5, 1]).pretrain(rows, epochs=1).fit(rows, iterations=25, rate=2.0, share=1.0)
    scored = net.predict(rows).collect()
    assert sum((r.score > 0.5) == (r.y == 1) for r in scored) > 100
    classes = network.Network([6, 5, 2]).fit(rows, iterations=25, rate=2.0, share=1.0)
    assert np.allclose(classes.forward(x)[-1].sum(axis=1), 1)
    assert sum(r.score == r.y for r in classes.predict(rows).collect()) > 100
    small = network.Rbm(3, 2, seed=3)
    every = np.array([[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)], dtype=float)
    p = np.exp(-small.free_energy(every))
    assert abs(small.log_likelihood(design(spark, every, every[:, 0])) - np.log(p / p.sum()).mean()) < 1e-9
    exact = lambda v, i: np.log(p[int(v @ [4, 2, 1])] / (p[int(v @ [4, 2, 1])] + p[int(np.abs(v - np.eye(3)[i]) @ [4, 2, 1])]))
    want = np.mean([3 * exact(v, k % 3) for k, v in enumerate(every)])
    assert abs(small.pseudo_likelihood(design(spark, every, every[:, 0])) - want) < 1e-9


def test_admission_follows_its_rule():
    """The turn moves even if the border stays, and a cluster that was waited for too long is passed over."""
    gate = crawl.Admission([0.9, 0.5, 0.5, 0.1], [0.2, 0.4, 0.6, 1.0], [0.2, 0.2, 0.2, 0.4], 10)
    turns = []
    for ratio in [0.1] * 4 + [0.5] * 8 + [0.9] * 8:
        gate.fetch(ratio)
        turns.append((gate.at, gate.border))
    assert turns == sorted(turns, key=lambda t: t[0]) and {t[0] for t in turns} >= {0, 1, 2}
    assert gate.used <= 10


def test_docstream_round_trip(spark, tmp_path):
    records.register(spark)
    rows = [("u1", "тело", None), ("u2", None, "text" * 5000), ("u3", "", "")]
    df = spark.createDataFrame(rows, "url string, body string, text string")
    df.coalesce(1).write.format("docstream").mode("append").save(str(tmp_path / "d"))
    back = spark.read.format("docstream").load(str(tmp_path / "d"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with open(tmp_path / "torn.bin", "wb") as f:
        data = records.encode("a", "b", "c")
        f.write(len(data).to_bytes(4, "little") + data + (99).to_bytes(4, "little") + b"xx")
    assert list(records.read_records(str(tmp_path / "torn.bin"), "skip")) == [("a", "b", "c")]
    with pytest.raises(ValueError):
        list(records.read_records(str(tmp_path / "torn.bin")))
    assert spark.read.format("docstream").option("torn", "skip").load(f"file://{tmp_path}/torn.*").count() == 1


def test_file_sources(spark, tmp_path):
    import base64

    pages = [(1, 1, "u", base64.b64encode("Привет".encode()).decode().rstrip("=")), (2, 0, "v", base64.b64encode("Привет".encode("cp1251")).decode())]
    (tmp_path / "pages.tsv").write_text("id\tmark\turl\tpage\n" + "\n".join("\t".join(map(str, r)) for r in pages) + "\n")
    got = {r.id: (r.mark, r.page) for r in files.labelled_pages(spark, str(tmp_path / "pages.tsv")).collect()}
    assert got == {1: (True, "Привет"), 2: (False, "Привет")}
    (tmp_path / "clicks.tsv").write_text("7\t[1, 2]\t[2]\n8\t[]\n")
    assert {r.query_id: (r.serp, r.clicked) for r in files.click_log(spark, str(tmp_path / "clicks.tsv")).collect()} == {7: ([1, 2], [2]), 8: ([], None)}
    docs = spark.createDataFrame([(k, f"t{k}") for k in (0, 1, 1000, 1001, 2500)], "doc_id bigint, text string")
    for part in (docs.limit(2), docs):
        files.append_shards(part, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 5
    assert {r.doc_id for r in files.lookup(spark, str(tmp_path / "shards"), [1, 1001]).collect()} == {1, 1001}
    (tmp_path / "urls").mkdir()
    (tmp_path / "urls" / "urls.wiki.qlink").write_text("http://a\nhttp://b")
    assert [(r.site, r.kind, r.url) for r in files.url_lists(spark, str(tmp_path / "urls")).orderBy("url").collect()] == [("wiki", "qlink", "http://a"), ("wiki", "qlink", "http://b")]
    (tmp_path / "m.csv").write_text("1,2,3\n4,5,6\n")
    assert [(r.y, r.x) for r in files.matrix(spark, str(tmp_path / "m.csv"), 1).orderBy("y").collect()] == [(2.0, [1.0, 3.0]), (5.0, [4.0, 6.0])]
    ranked = spark.createDataFrame([(1, 2, 5), (1, 1, 9)], "query_id bigint, place int, doc_id bigint")
    files.write_submission(ranked.coalesce(1), str(tmp_path / "sub"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "sub")).collect()] == [("1", "9"), ("1", "5")]


def test_entry_imports_and_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_word_can_be_replaced(spark, tmp_path):
    rng = random.Random(3)
    groups = [[f"{g}{k}" for k in "abcd"] for g in ("river", "house", "light", "stone", "music")]
    texts = [" ".join(rng.choice(rng.choice(groups)) if k % 9 == 0 else rng.choice(groups[n % 5]) for k in range(30)) for n in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [w for g in groups for w in g]
    spark.createDataFrame(list(enumerate(words)), "query_id bigint, query string").write.parquet(f"{tmp_path}/queries.parquet")
    asked = spark.read.parquet(f"{tmp_path}/queries.parquet")
    assert {r.term for r in rank_queries._synonyms(spark, str(tmp_path), asked).collect()} == set(words)
    assert len({r.term for r in rank_queries._synonyms(spark, str(tmp_path)).collect()}) < len(words)
    variants = rank_queries.query_variants(spark, str(tmp_path)).filter("replaced > 0")
    assert {r.query_id for r in variants.collect()} == set(range(len(words)))


def test_variants_are_merged_without_a_row_each(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{c}" for c in "abcdefghijklmnop"]
    docs = [(n, rng.choice([None, "", " ".join(rng.choices(words, k=3))]), None if n == 7 else " ".join(rng.choices(words, k=25))) for n in range(40)]
    texts = ["wa wb", "wa wa wb wa", " ".join(words[:5]), "wc zzz 12", "wd wd wd wd we wd wd", " ".join(words[:11]), None, "?"]
    asked = list(enumerate(texts))
    clicks = [(q, rng.sample(range(45), 12), [1]) for q, _ in asked] + [(99, [1, 2], None), (0, [0, 3, 44], [3])]
    for name, rows, kind in (("documents", docs, "doc_id bigint, title string, text string"), ("queries", asked, "query_id bigint, query string"), ("clicks", clicks, "query_id bigint, serp array<bigint>, clicked array<bigint>")):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    synonyms = spark.createDataFrame([(w, x, 0.95 - k / 50) for w in words for k, x in enumerate([*rng.sample([x for x in words if x != w], 3), f"new{w}"])], "term string, synonym string, sim double")
    d = str(tmp_path)
    pairs, queries = rank.shown(spark.read.parquet(f"{d}/clicks.parquet")), spark.read.parquet(f"{d}/queries.parquet")
    variants = rank.query_variants(queries, synonyms).filter("variant > 0").withColumn("v", F.col("query_id") * 100_000 + F.col("variant")).cache()
    each = rank_queries._first_rank(spark, d, pairs.join(variants, "query_id").select(F.col("v").alias("query_id"), "doc_id"), variants.select(F.col("v").alias("query_id"), "query"))
    extra = each.withColumnRenamed("query_id", "v").join(variants.select("v", "query_id", "replaced"), "v").select("query_id", "doc_id", "score", "replaced")
    want = {(r.query_id, r.doc_id): r.score for r in rank.merge_variants(rank_queries._first_rank(spark, d), extra).collect()}
    assert variants.count() > 2000 and max(want.values()) > 100

    def never(*_, **__):
        raise AssertionError("a variant became a row")

    monkeypatch.setattr(rank, "query_variants", never)
    monkeypatch.setattr(rank_queries, "_synonyms", lambda *_: synonyms)
    got = {(r.query_id, r.doc_id): r.score for r in rank_queries.variant_merge(spark, d).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-5 for k in want)


def test_sums_of_variants_in_any_parts():
    rng = np.random.default_rng(2)
    sizes, n_docs = [3, 1, 2, 3], 7
    rows = [(p, a, -1, int(rng.integers(5))) for p in range(4) for a in range(sizes[p])] + [(p, a, b, int(rng.integers(10, 13))) for p in range(3) for a in range(sizes[p]) for b in range(sizes[p + 1]) if rng.random() < 0.7]
    p, a, b, key = (np.array(c) for c in zip(*sorted(rows)))
    idf = (rng.random(13) + 0.1)[key]
    at, doc = (x.ravel() for x in np.meshgrid(np.arange(len(p)), np.arange(n_docs)))
    w, prior = rng.random((13, n_docs))[key[at], doc], rng.random(n_docs)
    want = np.zeros(n_docs)
    for v in itertools.product(*map(range, sizes)):
        sim = np.zeros(n_docs)
        for kind in (b < 0, b >= 0):
            has = [i for i in np.flatnonzero(kind) if v[p[i]] == a[i] and (b[i] < 0 or v[p[i] + 1] == b[i])]
            tf = {k: sum(key[i] == k for i in has) * idf[key == k][0] for k in {int(key[i]) for i in has}}
            for k, x in tf.items():
                sim += x / sum(y * y for y in tf.values()) ** 0.5 * w[np.flatnonzero(at == np.flatnonzero(key == k)[0])]
        want += 0.99 ** sum(o > 0 for o in v) * np.round(sim / sim.max() + prior, 6)
    for parts in ({}, {"cells": 10}, {"cells": 60, "block": 3}, {"block": 2}):
        assert np.allclose(rank.variant_sums(sizes, p, a, b, key, idf, at, doc, w, prior, **parts), want, atol=1e-4)
