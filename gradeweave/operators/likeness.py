"""Which names are alike, and the set of alike names each name uses.

Two names are alike when they share a sound code, are one edit apart, or one
begins or ends with the other, ignoring case. Names with one sound code are
all alike, so such a block may hold most of the names. Its pairs are therefore
never listed: a name's likenesses are kept as its *block* plus its *links*,
the alike names of other blocks. There are few links: prefixes and suffixes
give at most two per letter of a name, and one-edit pairs are bounded by
length and alphabet.

Names are folded to upper case; ``variants`` counts the spellings folded.
``node`` numbers a name by the position of its last-seen spelling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeweave.functions.aggregates import per_key
from gradeweave.functions.text import fold, is_blank, sound_code, sounds_or_looks_alike
from gradeweave.session import materialize

PARTS = ("first", "last")


def distinct_names(identities: DataFrame, first: str = "first_name", last: str = "last_name") -> DataFrame:
    """Distinct names of both parts with their first position: part, name, name_ord."""
    parts = F.array(
        *[
            F.struct(F.lit(part).alias("part"), F.col(column).alias("name"))
            for part, column in zip(PARTS, (first, last))
        ]
    )
    listed = identities.select(F.inline(parts), "first_ord").where(F.col("name").isNotNull())
    return listed.groupBy("part", "name").agg(F.min("first_ord").alias("name_ord"))


def similar_names(names: DataFrame, compare_to: str) -> DataFrame:
    """The names alike to one given name."""
    return names.where(sounds_or_looks_alike(F.col("name"), F.lit(compare_to)))


def name_nodes(names: DataFrame) -> DataFrame:
    """Case-folded names: node, part, key, block, blank, variants.

    Blank names are alike to nothing but themselves and get a block each.
    """
    folded = names.groupBy("part", fold(F.col("name")).alias("key")).agg(
        F.count(F.lit(1)).alias("variants"), F.max("name_ord").alias("key_ord")
    )
    key = F.col("key")
    code = F.when(is_blank(key), F.concat(F.lit("="), key)).otherwise(sound_code(key))
    return folded.select(
        (F.col("key_ord") * 2 + (F.col("part") == PARTS[1]).cast("int")).alias("node"),
        "part", "key",
        F.concat("part", F.lit(":"), code).alias("block"),
        is_blank(key).alias("blank"),
        "variants",
    )


def _without(position: Column) -> Column:
    """The key without its character at ``position``."""
    key = F.col("key")
    return F.concat(F.substr(key, F.lit(1), position - 1), F.substr(key, position + 1))


def _symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of each (node, block, variants) pair ``a``-``b``, once."""
    ends = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = pairs.select(F.inline(ends))
    return both.select(
        F.col("a.node").alias("node"), F.col("a.block").alias("block"),
        F.col("b.node").alias("linked"), F.col("b.block").alias("linked_block"),
        F.col("b.variants").alias("linked_variants"),
    ).distinct()


def _end() -> Column:
    return F.struct("node", "block", "variants")


def _one_edit_stems(nodes: DataFrame) -> DataFrame:
    """Each key less one character, with the place it was taken from."""
    letters = F.sequence(F.lit(1), F.length("key"))
    stems = nodes.where(~F.col("blank")).select(
        "node", "part", "key", "block", "variants", F.explode(letters).alias("place")
    )
    return stems.withColumn("stem", _without(F.col("place")))


def _substitutions(nodes: DataFrame, other_block_only: bool) -> DataFrame:
    """Pairs of equal length that differ at one place: they share place and stem.

    With ``other_block_only``, the blocks that share a stem are paired first,
    and only names of two such blocks meet. A stem of one block alone, however
    many names it has, pairs nothing.
    """
    stems = _one_edit_stems(nodes)
    by = ["part", "place", "stem"]
    left = stems.select(*by, F.col("block").alias("a_block"), _end().alias("a"))
    right = stems.select(*by, F.col("block").alias("b_block"), _end().alias("b"))
    if not other_block_only:
        return left.join(right, by).where("a.node < b.node").select("a", "b")
    held = stems.select(*by, "block").distinct()
    block_pairs = (
        held.withColumnRenamed("block", "a_block").join(held.withColumnRenamed("block", "b_block"), by)
        .where("a_block < b_block")
    )
    return left.join(block_pairs, [*by, "a_block"]).join(right, [*by, "b_block"]).select("a", "b")


def _fragments_of(nodes: DataFrame, fragments: Column) -> DataFrame:
    """Pairs where a fragment of ``a`` is the whole of ``b``."""
    named = nodes.where(~F.col("blank"))
    pieces = named.select("part", _end().alias("a"), F.explode(F.array_distinct(fragments)).alias("piece"))
    whole = named.select("part", F.col("key").alias("piece"), _end().alias("b"))
    return pieces.join(whole, ["part", "piece"]).select("a", "b")


def _stems_of_key() -> Column:
    return F.transform(F.sequence(F.lit(1), F.length("key")), _without)


def one_edit_pairs(nodes: DataFrame) -> DataFrame:
    """All pairs of distinct folded names one edit apart, in any block."""
    pairs = _substitutions(nodes, other_block_only=False).unionByName(_fragments_of(nodes, _stems_of_key()))
    return _symmetric(pairs)


def name_links(nodes: DataFrame) -> DataFrame:
    """Alike names of different blocks, in both directions."""
    size = F.length("key")
    cuts = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(cuts, lambda i: F.substr(F.col("key"), F.lit(1), i))
    suffixes = F.transform(cuts, lambda i: F.substr(F.col("key"), i + 1))
    fragments = F.concat(_stems_of_key(), prefixes, suffixes)
    pairs = _substitutions(nodes, other_block_only=True).unionByName(_fragments_of(nodes, fragments))
    return _symmetric(pairs.where("a.block <> b.block"))


@dataclass(frozen=True)
class NameGraph:
    nodes: DataFrame  # node, part, key, block, blank, variants, links, set_size
    links: DataFrame  # node, block, linked, linked_block, linked_variants
    blocks: DataFrame  # block, block_keys, block_variants, linked_any, last_node; one row per sound code


def name_graph(names: DataFrame) -> NameGraph:
    bare = materialize(name_nodes(names), "name-nodes")
    links = materialize(name_links(bare), "name-links")
    degree = links.groupBy("node").agg(
        F.count(F.lit(1)).alias("links"), F.sum("linked_variants").alias("link_variants")
    )
    linked = bare.join(degree, "node", "left").fillna(0, ["links", "link_variants"])
    # At most 26 * 7**3 + 1 sound codes exist per part: the only unbounded
    # blocks are those of blank names, and they are left out.
    blocks = (
        linked.where(~F.col("blank"))
        .groupBy("block")
        .agg(
            F.count(F.lit(1)).alias("block_keys"),
            F.sum("variants").alias("block_variants"),
            (F.max("links") > 0).alias("linked_any"),
            F.max("node").alias("last_node"),
        )
    )
    sized = linked.join(F.broadcast(blocks.select("block", "block_variants")), "block", "left")
    nodes = sized.select(
        "node", "part", "key", "block", "blank", "variants", "links",
        (F.coalesce("block_variants", "variants") + F.col("link_variants")).alias("set_size"),
    )
    return NameGraph(materialize(nodes, "name-sizes"), links, materialize(blocks, "name-blocks"))


def name_blocks(graph: NameGraph) -> DataFrame:
    """How crowded each sound code is: part, code, names, spellings, links. Names count once in any case; links are
    likenesses with names of other codes. Nothing is dropped for being crowded."""
    links = per_key(graph.links, ["block"], F.count(F.lit(1)).alias("links"))
    at = F.split("block", ":", 2)
    return graph.blocks.join(links, "block", "left").select(
        at[0].alias("part"), at[1].alias("code"), F.col("block_keys").alias("names"), F.col("block_variants").alias("spellings"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )


def _outranks(inner: str, outer: str) -> Column:
    """Of two nested sets the larger stays; of equal ones the later."""
    return (F.col(f"{inner}_size") < F.col(f"{outer}_size")) | (
        (F.col(f"{inner}_size") == F.col(f"{outer}_size")) & (F.col(inner) < F.col(outer))
    )


def _fingerprints() -> list[Column]:
    """Two independent 64-bit fingerprints of the set of linked nodes."""
    return [
        F.sum(F.xxhash64("linked").cast("decimal(20,0)")).alias("print_1"),
        F.bit_xor(F.xxhash64(F.lit("salt"), F.col("linked"))).alias("print_2"),
    ]


def _equal_sets(classes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of a block whose links equal those of a later node (node), and the last nodes of such classes (node,
    links).

    Fingerprints only propose a class. Each of its nodes is then compared with the last one, link by link; those that
    differ, if ever, are put into classes by the sorted links themselves.
    """
    by = ["block", "links", "print_1", "print_2"]
    last = classes.groupBy(*by).agg(F.max("node").alias("head"), F.count(F.lit(1)).alias("size"))
    proposed = classes.join(last.where("size > 1"), by).where("node <> head").select("node", "head", "links")
    members = links.select("node", "linked")
    of_head = links.select(F.col("node").alias("head"), "linked")
    equal = (
        proposed.join(members, "node").join(of_head, ["head", "linked"])
        .groupBy("node", "links").agg(F.count(F.lit(1)).alias("common")).where("common = links").select("node")
    )
    equal = materialize(equal, "equal-sets")
    unlike = proposed.join(equal, "node", "left_anti").select("node")
    spelt = (
        links.join(unlike, "node", "left_semi").groupBy("block", "node")
        .agg(F.count(F.lit(1)).alias("links"), F.array_sort(F.collect_list("linked")).alias("held"))
        .withColumn("head", F.max("node").over(Window.partitionBy("block", "held")))
    )
    followers = equal.unionByName(spelt.where("node <> head").select("node"))
    heads = last.select(F.col("head").alias("node"), "links").unionByName(spelt.where("node = head").select("node", "links"))
    return followers, heads


def _covered_within_block(graph: NameGraph) -> DataFrame:
    """Nodes whose links are a part of the links of another node of the block.

    Nodes with equal links are one class; only its last node can stay, and only
    such representatives are compared. A class is looked for at the linked name
    that the fewest classes of its block share.
    """
    nodes, links = graph.nodes, graph.links
    # No links at all: covered by any linked node of the block, or by a later node.
    bare = (
        nodes.where("links = 0 and not blank")
        .join(F.broadcast(graph.blocks.select("block", "linked_any", "last_node")), "block")
        .where("linked_any or node < last_node")
        .select("node")
    )

    classes = links.groupBy("block", "node").agg(F.count(F.lit(1)).alias("links"), *_fingerprints())
    followers, heads = _equal_sets(classes, links)

    head_nodes = heads.select("node", F.col("links").alias("head_links"))
    head_links = materialize(
        links.select("node", "block", "linked").join(head_nodes, "node"), "class-links"
    )
    sharing = per_key(head_links, ["block", "linked"], F.count(F.lit(1)).alias("sharing"))
    rarest = (
        head_links.join(sharing, ["block", "linked"])
        .groupBy("block", F.col("node").alias("inner"), F.col("head_links").alias("inner_links"))
        .agg(F.min(F.struct("sharing", "linked")).alias("at"))
        .where("at.sharing > 1")
        .select("block", "inner", "inner_links", F.col("at.linked").alias("linked"))
    )
    candidates = (
        rarest.join(
            head_links.select("block", "linked", F.col("node").alias("outer"), "head_links"),
            ["block", "linked"],
        )
        .where("inner_links < head_links")
        .select("inner", "inner_links", "outer")
    )
    inner_members = links.select(F.col("node").alias("inner"), "linked")
    outer_members = links.select(F.col("node").alias("outer"), "linked")
    nested = (
        candidates.join(inner_members, "inner")
        .join(outer_members, ["outer", "linked"])
        .groupBy("inner", "outer", "inner_links")
        .agg(F.count(F.lit(1)).alias("common"))
        .where("common = inner_links")
        .select(F.col("inner").alias("node"))
    )
    return bare.unionByName(followers).unionByName(nested)


def _covered_across_blocks(graph: NameGraph) -> DataFrame:
    """Nodes whose set lies within the set of a linked node.

    The linked node must reach the whole block of the inner one, and all the
    inner links that are outside its own block. Counts per (node, block) rule
    out nearly all pairs before any links are compared, and what is compared
    is never longer than the outer node's links.
    """
    nodes, links = graph.nodes, graph.links
    reach = per_key(links, ["node", "linked_block"], F.count(F.lit(1)).alias("reach"))
    size = nodes.select("node", "links", "set_size")
    inner = size.toDF("inner", "inner_links", "inner_size")
    outer = size.toDF("outer", "outer_links", "outer_size")
    inner_block = F.broadcast(graph.blocks.select(F.col("block").alias("inner_block"), "block_keys"))
    pairs = links.select(
        F.col("node").alias("inner"), F.col("block").alias("inner_block"),
        F.col("linked").alias("outer"), F.col("linked_block").alias("outer_block"),
    )
    whole_block = (
        pairs.join(inner_block, "inner_block")
        .join(reach.toDF("outer", "inner_block", "outer_reach"), ["outer", "inner_block"])
        .where("outer_reach = block_keys")
    )
    rest = (
        whole_block.join(reach.toDF("inner", "outer_block", "inner_reach"), ["inner", "outer_block"])
        .join(inner, "inner")
        .join(outer, "outer")
        .where(_outranks("inner", "outer"))
        .withColumn("rest", F.col("inner_links") - F.col("inner_reach"))
        .where("rest <= outer_links - block_keys")
        .select("inner", "outer", "outer_block", "rest")
    )
    inner_members = links.select(F.col("node").alias("inner"), "linked", F.col("linked_block").alias("via"))
    outer_members = links.select(F.col("node").alias("outer"), "linked")
    compared = (
        rest.where("rest > 0")
        .join(inner_members, "inner")
        .where("via <> outer_block")
        .join(outer_members, ["outer", "linked"])
        .groupBy("inner", "outer", "rest")
        .agg(F.count(F.lit(1)).alias("common"))
        .where("common = rest")
    )
    return (
        rest.where("rest = 0").select(F.col("inner").alias("node"))
        .unionByName(compared.select(F.col("inner").alias("node")))
    )


def maximal_names(graph: NameGraph) -> DataFrame:
    """Nodes whose set is a part of no other set; of equal sets, the last."""
    covered = _covered_within_block(graph).unionByName(_covered_across_blocks(graph)).distinct()
    return graph.nodes.join(covered, "node", "left_anti")


def name_owners(graph: NameGraph) -> DataFrame:
    """Each node with the owner of the set it uses: the smallest maximal set
    that holds it, the earliest of equals.

    Columns of the nodes, plus owner, owner_block and owner_size.
    """
    kept = materialize(maximal_names(graph).select("node", "block", "blank", "set_size"), "maximal-names")
    rank = F.struct(F.col("set_size").alias("size"), F.col("node").alias("owner"), F.col("block").alias("block"))
    in_block = kept.where(~F.col("blank")).groupBy("block").agg(F.min(rank).alias("own"))
    through = kept.select(F.col("node").alias("linked"), rank.alias("rank"))
    by_link = (
        graph.links.select("node", "linked").join(through, "linked")
        .groupBy("node").agg(F.min("rank").alias("via"))
    )
    # One row per sound code at most.
    chosen = graph.nodes.join(F.broadcast(in_block), "block", "left").join(by_link, "node", "left")
    itself = F.struct(F.col("set_size").alias("size"), F.col("node").alias("owner"), F.col("block").alias("block"))
    best = F.when(F.col("blank"), itself).otherwise(F.least("own", "via"))
    return chosen.withColumn("best", best).select(
        *graph.nodes.columns,
        F.col("best.owner").alias("owner"), F.col("best.block").alias("owner_block"),
        F.col("best.size").alias("owner_size"),
    )
