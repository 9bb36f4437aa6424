"""The relational name rules against the plain model, on random crowded names."""

import random

import pytest
from pyspark.sql import functions as F

from gradeweave.functions.text import sound_code
from gradeweave.operators import clusters as clu
from gradeweave.operators import likeness as lik
from gradeweave.operators.components import components
from gradeweave.plans.validate import repair_misspelled
from tests.model import alike, near, respell, sound, used_sets


def crowd(rng, size, letters, longest):
    """Names over few letters: many share sounds, prefixes, suffixes and edits."""
    names = set()
    while len(names) < size:
        name = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).capitalize()
        names.add(name.upper() if rng.random() < 0.1 else name)
    return sorted(names, key=lambda _: rng.random())


CROWDS = [(1, 120, "AEHWTDSL", 4), (2, 200, "ABCDELMNORST", 4), (3, 60, "AH", 6)]


def names_frame(spark, names):
    rows = [(part, n, i + 1) for part in ("first", "last") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "part string, name string, name_ord long")


@pytest.mark.parametrize("crowd_of", CROWDS)
def test_used_sets(spark, crowd_of):
    seed, *shape = crowd_of
    names = crowd(random.Random(seed), *shape)
    graph = lik.name_graph(names_frame(spark, names))
    owners = lik.name_owners(graph)
    got = {
        (r.part, r.key): (names[r.owner // 2 - 1], r.owner_size)
        for r in owners.select("part", "key", "owner", "owner_size").collect()
    }
    want = {n: (owner, len(members)) for n, (owner, members) in used_sets(names).items()}
    assert len(got) == 2 * len({n.upper() for n in names})
    for n, expected in want.items():
        assert got["first", n.upper()] == got["last", n.upper()] == expected, n
    # The links are the alike names of other blocks, no more and no fewer.
    linked = graph.links.count()
    folded = sorted({n.upper() for n in names})
    assert linked == 2 * sum(alike(a, b) and sound(a) != sound(b) for a in folded for b in folded)


def test_one_edit_pairs(spark):
    names = crowd(random.Random(4), 150, "ABCDE", 4)
    nodes = lik.name_nodes(names_frame(spark, names).where("part = 'first'"))
    pairs = {(r.node, r.linked) for r in lik.one_edit_pairs(nodes).select("node", "linked").collect()}
    place = {r.key: r.node for r in nodes.collect()}
    want = {(place[a], place[b]) for a in place for b in place if a != b and near(a, b)}
    assert pairs == want


def random_rows(seed, vocabulary, pairs, rows, letters, longest):
    rng = random.Random(seed)
    firsts, lasts = crowd(rng, vocabulary, letters, longest), crowd(rng, vocabulary, letters, longest)
    choices = [(rng.choice(firsts), rng.choice(lasts)) for _ in range(pairs)]
    choices += [(None, lasts[0]), (firsts[0], None), ("", lasts[1]), (firsts[1], ""), ("", "")]
    return [rng.choice(choices) for _ in range(rows)]


@pytest.mark.parametrize("at_once", [clu.AT_ONCE, 3])
@pytest.mark.parametrize(
    "shape", [(11, 25, 60, 150, "AEHWTDSL", 4), (12, 40, 150, 300, "ABCDELMNORST", 5), (13, 12, 60, 120, "AT", 5)]
)
def test_respelling(scores_of, monkeypatch, shape, at_once):
    monkeypatch.setattr(clu, "AT_ONCE", at_once)
    rows = random_rows(*shape)
    result = repair_misspelled(scores_of([{"first": f, "last": l} for f, l in rows]))
    got = [(r.first_name, r.last_name) for r in result.scores.orderBy("ord").collect()]
    want = respell(rows)
    assert got == want
    changed = {(old, new) for old, new in zip(rows, want) if old != new}
    assert result.messages.count() == len(changed)


def test_sound_code(spark):
    rng = random.Random(5)
    known = {
        "Snow": "S500", "Wood": "W300", "Albrecht": "A416", "ALbrecht": "A416", "Albrect": "A416",
        "Pfister": "P236", "Tymczak": "T522", "Ashcraft": "A261", "O'Brien": "O165", "Élan": "L500",
        "1Bob": "B100", "Sh Sh Sh": "S200", "Chchch": "C200", "": "0000", "李": "0000",
    }
    names = list(known) + ["".join(rng.choice("ABCDEHHIKLMNRSTWWXYZ") for _ in range(rng.randint(1, 8))) for _ in range(2000)]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.code for r in frame.select("name", sound_code(F.col("name")).alias("code")).collect()}
    assert {n: got[n] for n in known} == known
    assert got == {n: sound(n) for n in got}
    (missing,) = spark.sql("select cast(null as string) n").select(sound_code(F.col("n")).alias("c")).collect()
    assert missing.c == "0000"


def test_hot_key_is_split(spark):
    """A key that holds most members is split by the adaptive skew join."""
    from gradeweave.operators.clusters import _earliest_taker

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        half = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 97))
        members = spark.range(0, 60000, 1, 8).select(
            F.col("id").alias("pair"), half.alias("first_half"), F.lit("x").alias("last_half"))
        taken = _earliest_taker(members, members)
        assert taken.where("taker = 1").count() == 40000
        counted = taken.groupBy("taker").count()
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def chain(spark, n):
    """Each pair could take the next one."""
    classes = spark.range(n).selectExpr("id as pair", "concat('a', id) as first_half", "'x' as last_half")
    after = spark.range(1, n).selectExpr("id as pair", "concat('a', id - 1) as first_half", "'x' as last_half")
    return classes, classes.unionByName(after)


def jobs_of(spark, name, action):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return action(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_chain_settles_in_a_constant_number_of_jobs(spark):
    used = set()
    for n in (20, 2_000):
        leaders, jobs = jobs_of(spark, f"chain-{n}", lambda: clu._settle(*chain(spark, n)))
        assert sorted(r.pair for r in leaders.collect()) == list(range(0, n, 2))
        used.add(jobs)
    assert len(used) == 1


def test_chains_above_the_bound_are_settled_group_by_group(spark, monkeypatch):
    monkeypatch.setattr(clu, "AT_ONCE", 4)
    parts = [chain(spark, 4), chain(spark, 9)]
    shifted = [[t.selectExpr(f"pair + {100 * k} as pair", f"concat(first_half, '-{k}') as first_half", "last_half") for t in p] for k, p in enumerate(parts)]
    classes, members = (a.unionByName(b) for a, b in zip(*shifted))
    leaders = clu._settle(classes, members)
    assert sorted(r.pair for r in leaders.collect()) == [0, 2, 100, 102, 104, 106, 108]
    assert clu._settle(classes.limit(0), members.limit(0)).count() == 0


@pytest.mark.parametrize("crowd_of", CROWDS[:1])
def test_sets_with_one_fingerprint_are_compared_link_by_link(spark, monkeypatch, crowd_of):
    constant = [F.lit(0).cast("decimal(30,0)").alias("print_1"), F.lit(0).cast("long").alias("print_2")]
    monkeypatch.setattr(lik, "_fingerprints", lambda: [F.max(c).alias(n) for c, n in zip(constant, ("print_1", "print_2"))])
    test_used_sets(spark, crowd_of)


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 15)] + [(5, 5), (200, 201), (201, 202), (202, 200)]
    found = {r.u: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 21)} | {100 + i: 100 for i in range(1, 15)} | {201: 200, 202: 200}
