"""Grouping misspelt name pairs under their leaders.

Pairs are taken in order of first appearance. A pair not yet taken leads, and
takes all later pairs whose first name is in the set its first name uses and
whose last name is in the set its last name uses. What a pair takes depends
only on the owners of those two sets, its *class*. So neither pairs of name
pairs nor members of sets are listed: classes and name pairs meet at a few
keys, each made of a first and a last half, where a half is either a block
(all its names are members) or an owner (names of other blocks linked to it).

The order rule is settled in two ways. While many pairs are undecided, it goes
in rounds, all pairs at once: one that no undecided earlier pair could take
becomes a leader, and what leaders take is settled with them. A few pairs are
settled in order, within one row, whatever chains they form. Where a round
decides less than half, pairs that can affect each other are told apart, and
each such group that is small enough is settled in a row of its own; only
larger ones go on in rounds.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeweave.functions.aggregates import mode_first_seen, per_key
from gradeweave.functions.text import full_name, taken_as_same
from gradeweave.operators.components import components
from gradeweave.operators.likeness import PARTS, distinct_names, name_blocks, name_graph, name_owners
from gradeweave.session import materialize, scratch_folder

log = logging.getLogger(__name__)

PAIR = ["first_name", "last_name"]
#: Pairs that are settled one after the other within one row: some thousand keys are looked through for each.
AT_ONCE = 4_096


def name_pairs(identities: DataFrame) -> DataFrame:
    """Distinct pairs of present names, with first position and score count.
    A missing name matches nothing, so pairs without both are left out."""
    present = identities.where(F.col("first_name").isNotNull() & F.col("last_name").isNotNull())
    return present.groupBy(*PAIR).agg(F.min("first_ord").alias("pair"), F.sum("n").alias("n"))


def _placed(pairs: DataFrame, owners: DataFrame) -> DataFrame:
    """Pairs with node, block and owner of either name."""
    out = pairs
    for part in PARTS:
        names = owners.where(F.col("part") == part).select(
            F.col("key").alias(f"{part}_key"),
            F.col("node").alias(f"{part}_node"),
            F.col("block").alias(f"{part}_block"),
            F.col("owner").alias(f"{part}_owner"),
            F.col("owner_block").alias(f"{part}_owner_block"),
        )
        key = taken_as_same(F.col(f"{part}_name"))
        out = out.join(names, key == F.col(f"{part}_key")).drop(f"{part}_key")
    return out


def _owner_half(owner: Column) -> Column:
    return F.concat(F.lit("owner:"), owner.cast("string"))


def class_keys(placed: DataFrame) -> DataFrame:
    """The keys at which a pair's class is met: pair, first_half, last_half."""
    halves = [F.array(F.col(f"{p}_owner_block"), _owner_half(F.col(f"{p}_owner"))) for p in PARTS]
    return placed.select("pair", F.explode(halves[0]).alias("first_half"), halves[1].alias("_last")).select(
        "pair", "first_half", F.explode("_last").alias("last_half")
    )


def member_keys(placed: DataFrame, links: DataFrame, met: DataFrame) -> DataFrame:
    """The keys at which a pair may be taken, as far as some class is met there.

    What the first half of a key rules out is dropped before the last half is
    added, so the halves of a pair are not multiplied in full.
    """
    out = placed.select("pair", *[f"{p}_{x}" for p in PARTS for x in ("node", "block")])
    for part in PARTS:
        used = placed.select(F.col(f"{part}_owner").alias("linked")).distinct()
        through = (
            links.select("node", "linked").join(used, "linked", "left_semi")
            .select(F.col("node").alias(f"{part}_node"), _owner_half(F.col("linked")).alias(f"{part}_half"))
        )
        own = out.withColumn(f"{part}_half", F.col(f"{part}_block"))
        out = own.unionByName(out.join(through, f"{part}_node"))
        out = out.join(per_key(met, [f"{part}_half"], F.min("pair")), f"{part}_half", "left_semi")
    keys = ["first_half", "last_half"]
    return out.join(per_key(met, keys, F.min("pair")), keys, "left_semi").select("pair", *keys)


def _earliest_taker(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Per member pair, the earliest of ``heads`` (pair, first_half, last_half) it meets."""
    keys = ["first_half", "last_half"]
    least = per_key(heads, keys, F.min("pair").alias("taker"))
    return members.join(least, keys).groupBy("pair").agg(F.min("taker").alias("taker"))


def first_takers(identities: DataFrame) -> DataFrame:
    """Each pair with the earliest pair whose sets hold it, itself at the latest."""
    pairs, classes, members, _ = _prepare(identities)
    taken = _earliest_taker(members, classes)
    heads = pairs.select(
        F.col("pair").alias("taker"),
        F.col("first_name").alias("taker_first_name"), F.col("last_name").alias("taker_last_name"),
    )
    return pairs.join(taken, "pair").join(heads, "taker").select(
        *PAIR, "pair", "taker", "taker_first_name", "taker_last_name"
    )


def _prepare(identities: DataFrame):
    graph = name_graph(distinct_names(identities))
    owners = materialize(name_owners(graph), "name-owners")
    placed = materialize(_placed(name_pairs(identities), owners), "placed-pairs")
    classes = class_keys(placed)
    members = materialize(member_keys(placed, graph.links, classes), "member-keys")
    return placed, classes, members, graph


def _key() -> Column:
    return F.concat_ws("|", "first_half", "last_half")


def _in_order(classes: DataFrame, members: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The leading pairs of groups of at most ``AT_ONCE`` pairs: group by group, one pair after the other. ``groups``
    has pair and group; without it all pairs are one group."""
    keyed = members.select("pair", _key().alias("key"), F.lit(False).alias("is_class")).unionByName(
        classes.select("pair", _key().alias("key"), F.lit(True).alias("is_class")))
    listed = lambda is_class: F.collect_list(F.when(F.col("is_class") == is_class, F.col("key")))
    pairs = keyed.groupBy("pair").agg(listed(True).alias("takes_at"), listed(False).alias("met_at"))
    pairs = pairs.withColumn("group", F.lit(0).cast("long")) if groups is None else pairs.join(groups, "pair")
    queue = pairs.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pair", "takes_at", "met_at"))).alias("queue"))
    nobody = F.struct(F.array().cast("array<bigint>").alias("leaders"), F.array().cast("array<string>").alias("led"))

    def settled(so_far: Column, x: Column) -> Column:
        leads = F.struct(
            F.concat(so_far["leaders"], F.array(x["pair"])).alias("leaders"),
            F.concat(so_far["led"], x["takes_at"]).alias("led"))
        return F.when(F.arrays_overlap(so_far["led"], x["met_at"]), so_far).otherwise(leads)

    return queue.select(F.explode(F.aggregate("queue", nobody, settled)["leaders"]).alias("pair"))


def _groups(classes: DataFrame, members: DataFrame) -> DataFrame:
    """Open pairs that can affect each other, directly or not: pair, group, size."""
    at = members.select("pair", _key().alias("key")).unionByName(classes.select("pair", _key().alias("key"))).distinct()
    links = at.join(per_key(at, ["key"], F.min("pair").alias("least")), "key").select("pair", "least")
    roots = components(links).withColumnRenamed("u", "pair")
    grouped = members.select("pair").distinct().join(roots, "pair", "left").select("pair", F.coalesce("root", "pair").alias("group"))
    grouped = materialize(grouped, "conflict-groups")
    return grouped.join(per_key(grouped, ["group"], F.count(F.lit(1)).alias("size")), "group")


def _settle(classes: DataFrame, members: DataFrame) -> DataFrame:
    """The leading pairs.

    Classes and members shrink to the undecided pairs once these have halved,
    so late rounds read little. Leaders of all steps go to one folder.
    """
    spark = members.sparkSession
    folder = scratch_folder(spark, "leaders")
    steps = 0

    def store(leading: DataFrame) -> DataFrame:
        nonlocal steps
        path = f"{folder}/step={steps}"
        leading.write.parquet(path)
        steps += 1
        return spark.read.schema("pair long").parquet(path)

    still = lambda df, pairs: df.join(pairs, "pair", "left_semi")
    open_pairs = members.select("pair").distinct()
    held = left = open_pairs.count()
    while left > AT_ONCE:
        open_classes, open_members = still(classes, open_pairs), still(members, open_pairs)
        leading = store(_earliest_taker(open_members, open_classes).where("pair = taker").select("pair"))
        settled = _earliest_taker(open_members, still(open_classes, leading)).where("taker <= pair").select("pair")
        open_pairs = materialize(open_pairs.join(settled, "pair", "left_anti"), "open-pairs")
        before, left = left, open_pairs.count()
        if left > AT_ONCE and 2 * left > before:  # chains
            open_classes, open_members = still(classes, open_pairs), still(members, open_pairs)
            groups = _groups(open_classes, open_members)
            few = materialize(groups.where(F.col("size") <= AT_ONCE).select("pair", "group"), "small-groups")
            store(_in_order(still(open_classes, few), still(open_members, few), few))
            open_pairs = materialize(open_pairs.join(few, "pair", "left_anti"), "open-pairs")
            left = open_pairs.count()
        if 2 * left <= held and left > AT_ONCE:
            classes, members = (materialize(still(x, open_pairs), "open-keys") for x in (classes, members))
            held = left
    if left or not steps:
        store(_in_order(still(classes, open_pairs), still(members, open_pairs)))
    log.info("name clusters settled in %d steps", steps)
    return spark.read.schema("pair long, step int").parquet(folder).select("pair")


def clusters_and_blocks(identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``name_clusters`` gives, and the blocks of names that sound alike (see ``name_blocks``)."""
    pairs, classes, members, graph = _prepare(identities)
    leaders = _settle(classes, members)
    taken = _earliest_taker(members, classes.join(leaders, "pair", "left_semi"))
    clusters = pairs.join(taken.withColumnRenamed("taker", "leader"), "pair").select(*PAIR, "pair", "n", "leader")
    return clusters, name_blocks(graph)


def name_clusters(identities: DataFrame) -> DataFrame:
    """Each pair with its leader: first_name, last_name, pair, n, leader."""
    return clusters_and_blocks(identities)[0]


def canonical_names(clusters: DataFrame) -> DataFrame:
    """Each pair with the commonest first and the commonest last name of its
    cluster, chosen independently of each other."""
    names = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("name")) for c in PAIR])
    listed = clusters.select("leader", "pair", "n", F.inline(names))
    common = mode_first_seen(listed, ["leader", "part"], "name", "n", "pair")
    chosen = per_key(
        common, ["leader"],
        *[F.max(F.when(F.col("part") == c, F.col("name"))).alias(f"canonical_{c}") for c in PAIR],
    )
    return clusters.join(chosen, "leader")


def misspelled_pairs(canonical: DataFrame) -> DataFrame:
    """The pairs to be rewritten, with the identifier they get."""
    first, last = F.col("canonical_first_name"), F.col("canonical_last_name")
    return canonical.where((F.col("first_name") != first) | (F.col("last_name") != last)).select(
        *PAIR, "canonical_first_name", "canonical_last_name",
        full_name(first, last).alias("canonical_identifier"),
    )
