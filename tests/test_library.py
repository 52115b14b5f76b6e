import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.functions.session import checkpointed
from sparkloom.operators import approx, assembly, generate, gnn, graph, market, pattern
from sparkloom.schema import Pattern
from sparkloom.sources import files, sinks

BUYER, DISTRIBUTOR, ENGINEER = 1128501731262832684, 1472154222902711100, 735713441679521195
# fixed values: the planted pattern of the input format
PLANTED = f"""#type,person1,person2,forum,forum_event,publication,topic,date,lat,lon
Sale,1419850416906085161,{BUYER},,,,2869238,09/28/2018,,
Sale,477384404927196020,{BUYER},,,,271997,09/30/2018,,
Sale,{DISTRIBUTOR},{BUYER},,,,185785,09/28/2018,,
Sale,{ENGINEER},{BUYER},,,,11650,10/10/2018,,
Sale,{DISTRIBUTOR},529550602103217450,,,,185785,2/17/2019,,
Topic,,,,,,60,,40.67,-73.94
Topic,,,,,,901,,40.7,-74.0
Topic,,,,,,902,,10.0,-10.0
ForumEvent,,,1,11,,,1/2/2018,,
ForumEvent,,,1,12,,,1/3/2018,,
ForumEvent,,,2,21,,,1/4/2018,,
ForumEvent,,,2,22,,,1/5/2018,,
Includes,,,1,11,,,,,
HasTopic,,,1,,,60,,,
HasTopic,,,,11,,44311,,,
HasTopic,,,,12,,44311,,,
HasTopic,,,,21,,771572,,,
HasTopic,,,,21,,179057,,,
HasTopic,,,,21,,127197,,,
HasTopic,,,,22,,69871376,,,
HasTopic,,,,22,,1049632,,,
Author,{BUYER},,,11,,,,,
Author,{BUYER},,,12,,,,,
Author,{BUYER},,,21,,,,,
Author,{ENGINEER},,,,31,,,,
HasTopic,,,,,31,43035,,,
HasOrg,,,,,31,901,,,
"""


def load(spark, tmp_path, text):
    path = tmp_path / "records.csv"
    path.write_text(text)
    return files.views(files.records(spark, str(path)))


def people(df):
    return sorted(r[0] for r in df.collect())


def test_planted_pattern_is_found(spark, tmp_path):
    t = load(spark, tmp_path, PLANTED)
    assert people(pattern.exact_match(t, Pattern())) == [BUYER]
    assert people(pattern.partial_match(t, Pattern())) == [BUYER]
    row = pattern.qualified_buyers(t["sale"], Pattern()).collect()
    assert [(r[0], str(r[1])) for r in row] == [(BUYER, "2018-09-28")]


@pytest.mark.parametrize(
    "old, new, exact, partial",
    [
        ("ForumEvent,,,2,21,,,1/4/2018,,", "ForumEvent,,,2,21,,,9/28/2018,,", False, True),  # not strictly before
        (f"Sale,{DISTRIBUTOR},529550602103217450,,,,185785,2/17/2019,,\n", "", False, False),  # one customer only
        ("HasOrg,,,,,31,901,,,", "HasOrg,,,,,31,902,,,", False, False),  # far away
        ("HasOrg,,,,,31,901,,,", "HasOrg,,,,,31,999,,,", False, False),  # unknown organization
        (f"Author,{BUYER},,,12,,,,,", "Author,77,,,12,,,,,", True, False),  # events by two authors
    ],
)
def test_near_misses(spark, tmp_path, old, new, exact, partial):
    assert old in PLANTED
    t = load(spark, tmp_path, PLANTED.replace(old, new))
    assert (people(pattern.exact_match(t, Pattern())) == [BUYER]) == exact
    assert (people(pattern.partial_match(t, Pattern())) == [BUYER]) == partial


def test_edges_have_reverses(spark, tmp_path):
    e = files.uniform_edges(load(spark, tmp_path, PLANTED)).collect()
    assert Counter(r["type"] for r in e)["SALE"] == Counter(r["type"] for r in e)["PURCHASE"] == 5
    assert len(e) == 2 * (5 + 4 + 1 + 9 + 1)


def test_small_readers_and_sinks(spark, tmp_path):
    (tmp_path / "social.csv").write_text("1,2\n")
    assert sorted(map(tuple, files.social(spark, str(tmp_path / "social.csv")).collect())) == [(1, 2), (2, 1)]
    (tmp_path / "seeds.json").write_text('[{"Seeds": [4, 5]}]')
    assert people(files.influencers(spark, str(tmp_path / "seeds.json"))) == [4, 5]
    (tmp_path / "e.csv").write_text("id,f0,f1,f2\n7,1,2,3\n")
    assert files.embedding_file(spark, str(tmp_path / "e.csv"), 2).collect()[0]["embedding"] == [1.0, 2.0]
    (tmp_path / "r.fa").write_text(">x\nACTG\n>y\nGG\n")
    assert sorted(r[0] for r in files.fasta(spark, str(tmp_path / "r.fa")).collect()) == ["ACTG", "GG"]
    sinks.write_contigs(spark.createDataFrame([("ACT",)], "contig string"), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == [">contig_l_3", "ACT"]
    (tmp_path / "c.csv").write_text("s,1,2,8486,2/3/2018,,,5.5\n")
    assert tuple(files.commercial(spark, str(tmp_path / "c.csv")).collect()[0])[:3] == (1, 2, 8486)


def hand_graph(spark):
    rows = [(1, 2, "SALE"), (1, 2, "SALE"), (2, 3, "AUTHOR"), (3, 1, "HASORG")]
    return spark.createDataFrame([(a, b, t, "PERSON", "TOPIC" if t == "HASORG" else "PERSON") for a, b, t in rows], "src long, dst long, type string, src_type string, dst_type string")


def test_features_and_offsets_by_hand(spark):
    e = hand_graph(spark)
    v = {r["id"]: r for r in graph.vertices(e).collect()}
    assert [(v[i]["gid"], v[i]["degree"], v[i]["start"]) for i in (1, 2, 3)] == [(0, 2, 0), (1, 1, 2), (2, 1, 3)]
    two = {r["id"]: r for r in graph.two_hop(e).collect()}
    assert two[1]["g2"] == 2 and two[2]["g8"] == 1 and two[3]["g0"] == 2
    assert sorted(tuple(r) for r in graph.csr_edges(e).select("pos", "src_gid", "dst_gid").collect()) == [(0, 0, 1), (1, 0, 1), (2, 1, 2), (3, 2, 0)]


def test_ego_graphs_are_made_of_edges(spark):
    e, roots = hand_graph(spark), spark.createDataFrame([(1,)], "id long")
    both = {(r["src"], r["dst"]) for r in e.collect()}
    for r in graph.ego_sampled(e, roots).collect():
        assert r["src"] == r["dst"] or (r["src"], r["dst"]) in both or (r["dst"], r["src"]) in both
    assert {(r["src"], r["dst"]) for r in graph.ego_induced(e, roots).collect()} == both


def test_market_without_influencer(spark):
    rows = [(1, 1, 100.0), (4, 4, 50.0), (1, 2, 40.0), (4, 3, 10.0), (2, 3, 20.0), (2, 5, 5.0)]
    sale = spark.createDataFrame([(a, b, "P", None, x) for a, b, x in rows], "seller long, buyer long, product string, date date, amount double")
    out = sorted((r["seller"], r["buyer"], r["amount"]) for r in market.adjusted(sale, "P", spark.createDataFrame([(2,)], "id long")).collect())
    assert out == [(4, 3, 10.0), (4, 3, 20.0)]  # 3 has another supplier with slack, 5 has none
    lost = spark.createDataFrame([(4, 3, None, 10.0)], "seller long, buyer long, date date, amount double")
    kept = market.cancel_one(spark.createDataFrame([(4, 3, None, 10.0)] * 2, lost.schema), lost)
    assert kept.count() == 1


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(10, 15), st.integers(0, 3)), max_size=12), st.integers(1, 3))
@settings(max_examples=100, deadline=None)
def test_greedy_is_stable(edges, rounds):
    edges = list({(a, b): (a, b, float(s)) for a, b, s in edges}.values())
    got = approx.greedy(edges, rounds)
    assert len({b for _, _, b, _ in got}) == len(got)
    first = {a: (s, b) for k, a, b, s in got if k == 1}
    owner = {b: (s, a) for k, a, b, s in got if k == 1}
    for a, b, s in edges:  # nobody would rather have each other
        assert not (s > 0 and (a not in first or (s, b) > first[a]) and (b not in owner or (s, a) > owner[b]))


@pytest.mark.parametrize("rounds", [1, 3])
def test_match_takes_what_greedy_takes_of_all_pairs(spark, rounds):
    """vertices of equal histograms, one of them very common, and ties in similarity, against plain loops."""
    rng = random.Random(rounds)
    shapes = [[rng.choice([0, 0, 1, 2]) for _ in range(approx.BINS)] for _ in range(6)] + [[2] * approx.BINS, [1] * approx.BINS, [0] * approx.BINS]
    rows = [(kind, i, *shapes[rng.choice([0, 0, 0, *range(9)])]) for kind in "AB" for i in range(120)]
    data = spark.createDataFrame(rows, "vtype string, id long, " + ", ".join(f"h{i} long" for i in range(approx.BINS))).repartition(3)
    pattern = data.where("id % 8 = 0")

    def similarity(a, b):
        norm = lambda v: math.sqrt(sum(x * x for x in v))
        return math.sqrt(sum(min(x, y) ** 2 for x, y in zip(a, b, strict=True))) * sum(x * y for x, y in zip(a, b, strict=True)) / (norm(a) * norm(b)) if any(a) and any(b) else 0.0

    pairs = [(p[0], p[1], r[1], similarity(p[2:], r[2:])) for p in rows if p[1] % 8 == 0 for r in rows if r[0] == p[0]]
    got = approx.similarity_edges(pattern, data, 6).collect()
    assert sorted((*r[:3], round(r[3], 6)) for r in pairs if r[3] > 0) == sorted(map(tuple, got))
    want = [(kind, *g) for kind in "AB" for g in approx.greedy([p[1:] for p in pairs if p[0] == kind], rounds)]
    assert sorted(map(tuple, approx.match(pattern, data, rounds).collect())) == sorted(want)
    assert approx.match(pattern.limit(0), data, rounds).count() == 0


def test_match_goes_deeper_where_the_best_are_used_up(spark, monkeypatch):
    """few of the classes of each pattern class are sent at first; all want the same, so that more are asked for."""
    rng = random.Random(5)
    rows = [("A", i, *[rng.randrange(1, 40) if k < 3 else 0 for k in range(approx.BINS)]) for i in range(400)]
    data = spark.createDataFrame(rows, "vtype string, id long, " + ", ".join(f"h{i} long" for i in range(approx.BINS)))
    pattern = data.where("id % 10 = 0")
    counts = np.array([r[2:] for r in rows], float)
    sims = np.stack(list(approx.similarities(counts[::10], counts)))
    pairs = [(10 * i, j, float(sims[i, j])) for i in range(40) for j in range(400)]
    sent = []
    candidates = approx.candidates
    monkeypatch.setattr(approx, "candidates", lambda *a: sent.append(candidates(*a)) or sent[-1])
    got = approx.match(pattern, data, 3, depth=1).collect()
    assert sorted(map(tuple, got)) == sorted(("A", *g) for g in approx.greedy(pairs, 3))
    sizes = [df.count() for df in sent]
    assert sizes[0] <= 40 * 4 and sizes == sorted(sizes) and 1 < len(sizes) < 5


def test_pairs_of_vertices_are_neither_sent_nor_sorted(spark):
    """they are made of short arrays of ids after the last exchange, in generated code that the join has no part in."""
    rows = [("A", None if i == 7 else i, *[1 + i % 3 if k < 3 else i % 2 for k in range(approx.BINS)]) for i in range(500)]
    data = spark.createDataFrame(rows, "vtype string, id long, " + ", ".join(f"h{i} long" for i in range(approx.BINS)))
    edges = approx.similarity_edges(data.where("id % 5 = 0"), data, 6)
    assert sorted(Counter(r["rhs"] for r in edges.collect()).items(), key=str) == sorted(((r[1], 100) for r in rows), key=str)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("Join")]
    assert last.count("Generate explode") == 2 and last.index("Coalesce") > last.rindex("Generate explode") and "Exchange" not in last
    arrays = approx.bundles(data, "ids").collect()
    assert sum(len(r["ids"]) for r in arrays) == 500 and max(len(r["ids"]) for r in arrays) < 64


@given(st.lists(st.tuples(st.booleans(), st.sampled_from("ACTG"), st.just(False), st.integers(1, 9), st.integers(1, 5)), min_size=1, max_size=8, unique_by=lambda a: (a[0], a[1])))
@settings(max_examples=100, deadline=None)
def test_wires_keep_totals(affixes):
    before, after = assembly.with_ends(affixes)
    wired = assembly.wires(before, after)
    for k, side in enumerate((before, after)):
        for i, a in enumerate(side):
            assert sum(w[3] for w in wired if w[k] == i) == a[3]


@pytest.mark.parametrize("threshold", [1, 40])
def test_contig_round_trip(spark, threshold):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACTG") for _ in range(500))
    reads = spark.createDataFrame([(genome[i : i + 60],) for i in range(0, 441, 20)] + [("ACN" * 10,), ("AC",)], "read string")
    counts = assembly.kmer_counts(reads, 15)
    assert counts.count() == 486
    nodes = assembly.macro_nodes(counts, 1, 100.0)
    assert [r[0] for r in assembly.contigs(nodes, checkpointed, threshold).collect()] == [genome]


def test_pi_and_auc(spark):
    assert abs(generate.pi(spark, 1_000_000).first()[0] - 3.14159) < 0.01
    scored = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1)], "score long, label int")
    assert gnn.auc(scored).first()[0] == pytest.approx(0.875)


def test_gradients_and_training(spark):
    rng = np.random.default_rng(0)
    w = gnn.initial(3, 4, 2, 1)
    x, src, dst = rng.normal(size=(5, 3)), np.array([0, 1, 2, 3, 4, 0]), np.array([1, 2, 0, 0, 0, 0])
    loss, _, g = gnn.gradients(w, x, src, dst, 0, 1)
    w["w1"][1, 2] += 1e-5
    again = gnn.gradients(w, x, src, dst, 0, 1)[0]
    assert (again - loss) / 1e-5 == pytest.approx(g["w1"][1, 2], abs=1e-3)
    e = spark.createDataFrame([(i, i, i) for i in range(20)], "root long, src long, dst long")
    f = spark.createDataFrame([(i, [float(i % 2), 1.0, 0.0]) for i in range(20)], "id long, features array<double>")
    graphs = gnn.subgraphs(e, f, spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, label int"))
    w, how = gnn.train(graphs, 3, 2, gnn.Training(epochs=25, rate=0.1))
    assert how.history[-1][1] == 1.0
    assert gnn.classify(graphs, w, 3).where("label = predicted").count() == 20


def test_entry_stands_without_text_operators():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert "exact_match" in __spark_entry__.queries()


@pytest.mark.parametrize("k", [1, 5, 12, 31, 32, 33])
def test_kmer_counts_of_long_and_odd_reads(spark, k):
    rng = random.Random(k)
    reads = ["".join(rng.choice("ACTGN" if rng.random() < 0.05 else "ACTG") for _ in range(n)) for n in (0, 3, 40, 90, 5000)] + [None, "A" * 300, "T" * 64]
    want = Counter(r[i : i + k] for r in reads if r for i in range(len(r) - k + 1) if set(r[i : i + k]) <= set("ACTG"))
    got = assembly.kmer_counts(spark.createDataFrame([(r,) for r in reads], "read string"), k)
    assert {r["kmer"]: r["n"] for r in got.collect()} == want
