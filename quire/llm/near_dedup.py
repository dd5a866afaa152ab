"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

1. Every text becomes the set of 64-bit hashes of its five-word shingles, and the k smallest are its sketch. Texts with
   equal sets form one class, and one representative of each class goes on.
2. Inverted lists of retained values find overlaps. Sketches of two sets with similarity t share about t*k values, and
   fewer than T with a chance of some 1e-6 if t is the threshold itself, so only the s-T+1 rarest of a sketch's s values need lists: two sets that
   share T of them share one of those. Values of a passage that many unlike texts quote are frequent and stay out. In a
   list, two members may pair only if as many values as they need to share are left from this one on in both orders: the
   first value that a linked pair shares always allows that.
3. Every member of a list goes to a centre, the member with the highest mean frequency of its values: an original rather
   than an altered copy. These pairs are estimated from the sketch of their union and verified on the full sets.
4. A list may still hold several components. Its members, by ranges of sizes, are then all compared with one centre, which
   leaves each text's edits: the shingles that it has and the centre has not, or the other way round. Linked texts differ
   in at most a seventh of their sizes (for t = 0.75), so two texts of which one is not linked with the centre share many
   edits, and never all of them by chance: a prefix join on edits, rare ones first, finds all such pairs. Two texts that
   merely are both altered share no rare edit.
5. Lists of edits are treated as lists of values were: the member with the fewest edits is tested with all others, round by
   round as long as that links something, so a family of N altered copies costs N pairs. Where two components of several
   texts still meet, the texts that meet are compared with one centre of the two, as in 4. Pairs of texts that are in
   different components after all that, share enough rare edits and were not both compared with such a centre are compared
   one by one. What is compared how is a matter of cost; the components are those of all links either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.decontaminate import bitmap
from quire.llm.decontaminate import members as held
from quire.llm.graph import components
from quire.llm.shared import discard, written
from quire.llm.textkit import SPACED, Words, chain, mix, tidy, words

SHINGLE = 5
#: Retained values, and how many of them two linked sketches of full length share at least.
SKETCH = 128
#: Two parts that have so many texts each in one list of edits get a centre. Which pairs are compared depends on it, links don't.
SEVERAL = 4


def shared_least(k: int, percent: int) -> int:
    """A count that Binomial(k, t), t = percent/100, falls below with a chance of some 1e-6 (4.5 deviations)."""
    t = percent / 100
    return max(1, math.floor(k * t - 4.5 * math.sqrt(k * t * (1 - t))))


def shingle_sets(w: Words, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; a row of fewer words has one of all its words."""
    each = w.hashes()
    all_rows = chain(each, size)
    for b, e in zip(w.begins, w.ends, strict=True):
        if e - b >= size:
            h = np.sort(all_rows[b : e - size + 1])
            yield h[np.concatenate(([True], h[1:] != h[:-1]))]
        else:
            yield chain(each[b:e], int(e - b)) if e > b else np.empty(0, dtype=np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """``id, n, k1, k2, sketch``: set size, 128 bits that stand for the set, the k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(1), SPACED):
                sets = list(shingle_sets(w, size))
                n = np.array([len(x) for x in sets], dtype=np.int64)
                one = np.array([int(mix(x ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)) for x in sets], dtype=np.uint64).view(np.int64)
                two = np.array([int(mix(x * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)) for x in sets], dtype=np.uint64).view(np.int64)
                ids = batch.column(0).slice(w.first, len(sets))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(one), pa.array(two), _lists([x[:k] for x in sets])], ["id", "n", "k1", "k2", "sketch"])

    return docs.mapInArrow(tidy(run), "id long, n long, k1 long, k2 long, sketch array<long>")


def full_sets(docs: DataFrame, size: int, bits: np.ndarray) -> DataFrame:
    """``id, hashes``: the whole sorted set of each text of which the bitmap may hold the hash of the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(held(batch.column(2).to_numpy().view(np.uint64), bits)))
            for w in words(batch.column(1), SPACED):
                sets = list(shingle_sets(w, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(sets)), _lists(sets)], ["id", "hashes"])

    return docs.select("id", "text", F.xxhash64("id").alias("key")).mapInArrow(tidy(run), "id long, hashes array<long>")


def alike(x: np.ndarray, y: np.ndarray, k: int, percent: int) -> bool:
    """Whether two sorted sets have 100*|intersection| >= percent*|union|; a union sketch far below settles it early."""
    small, large = sorted((len(x), len(y)))
    if small == 0 or 100 * small < percent * large:
        return False
    if small > 2 * k:
        a, b = x[:k], y[:k]
        union = np.union1d(a, b)[:k]
        if int(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) < shared_least(k, percent):
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int, edits: bool = False) -> DataFrame:
    """Those of ``a, b`` whose full sets are alike, written; with ``edits`` all of them, ``linked`` or not, and where they differ.

    ``b`` may be the centre of very many pairs. ``pairs`` and the sets that they need are written tables, so a partition of that
    join with a hot ``b`` can be split; the second join is on ``a``, which has few. Rounds with few pairs don't shuffle all sets.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    some = written(sets.join(ids, "id", "left_semi"), "some")
    right = pairs.join(some, pairs.b == some.id).select("a", "b", F.col("hashes").alias("hb"))
    both = right.join(some, right.a == some.id).select("a", "b", F.col("hashes").alias("ha"), "hb")
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([v.values.to_numpy().view(np.uint64) for v in batch.column(i)] for i in (2, 3))
            ok = [alike(p, q, k, percent) for p, q in zip(x, y, strict=True)]
            apart = pa.array([np.setxor1d(p, q, assume_unique=True).view(np.int64) if edits else None for p, q in zip(x, y, strict=True)], kind)
            sizes = [pa.array([len(p) for p in v], pa.int64()) for v in (x, y)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(ok, pa.bool_()), apart], ["a", "b", "na", "nb", "linked", "edits"])
            yield out if edits else out.filter(pa.array(ok, pa.bool_()))

    out = written(both.mapInArrow(tidy(run), "a long, b long, na long, nb long, linked boolean, edits array<long>"), "stars" if edits else "links")
    discard(some)
    return out


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, part`` with the links ``a, b`` taken in: nodes of one part are connected, but not all connected ones are of one.
    One step towards components: a part takes the smallest part that it is linked with."""
    x, y = (labels.select(F.struct("node", "part").alias(c)) for c in "xy")
    ends = links.join(x, F.col("a") == F.col("x.node"), "left").join(y, F.col("b") == F.col("y.node"), "left")
    ends = ends.select(F.coalesce("x.part", "a").alias("p"), F.coalesce("y.part", "b").alias("q"))
    lower = written(ends.select(F.greatest("p", "q").alias("part"), F.least("p", "q").alias("to")).where("part <> to").groupBy("part").agg(F.min("to").alias("to")), "lower")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left").select("node", F.coalesce("part", "node").alias("part"))
    every = nodes.union(labels.join(nodes.select("node"), "node", "left_anti"))
    return every.join(lower, "part", "left").select("node", F.coalesce("to", "part").alias("part"))


def edit_lists(tested: DataFrame, percent: int) -> DataFrame:
    """``b, h, a, na, linked, e, weak, strong, left``: the edits h against a centre b that texts a need for the prefix join.

    ``|x ^ y| <= q*(|x| + |y|)`` with q = (1-t)/(1+t), and ``|x ^ y| = |Ex| + |Ey| - 2*|Ex & Ey|`` for edits Ex, Ey against one
    centre c. So linked texts share ``(|Ex| - q*|x| + |Ey| - q*|y|) / 2`` edits at least; that is ``(|Ex| - q*(|x| + |c|)) / 2`` or
    more (``weak``), which is positive for x not linked with c, and for any partner y of such a text above
    ``(|Ey| - q*(|y| - |c|)) / 2`` (``strong``). ``left`` counts a text's edits from this one on, in order of rarity.
    """
    q = (100 - percent) / (100 + percent)
    open_ = written(tested.groupBy("b").agg(F.min("linked").alias("all")).where("not all").select("b"), "open")
    every = tested.join(open_, "b").select("b", "a", "na", "nb", "linked", F.size("edits").alias("e"), F.explode("edits").alias("h"))
    often = written(every.groupBy("b", "h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    of = every.join(often, ["b", "h"]).groupBy("b", "a", "na", "nb", "linked", "e").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("x"))
    weak, strong = ((F.col("e") - q * (F.col("na") + sign * F.col("nb"))) / 2 - 1e-6 for sign in (1, -1))
    tokens = of.select("b", "a", "na", "linked", "e", weak.alias("weak"), strong.alias("strong"), F.size("x").alias("m"), F.posexplode("x").alias("pos", "v"))
    tokens = tokens.select("b", "v.h", "a", "na", "linked", "e", "weak", "strong", (F.col("m") - F.col("pos")).alias("left"))
    return tokens.where(F.col("left") >= F.when(F.col("linked"), F.col("strong")).otherwise(F.col("weak")))


def may_share(x: str, y: str, percent: int) -> Column:
    """Bounds for two members of a list of edits, x not linked with the centre: as many edits as they need are left in both."""
    q = (100 - percent) / (100 + percent)
    need = (F.col(f"{x}e") + F.col(f"{y}e") - q * (F.col(f"{x}na") + F.col(f"{y}na"))) / 2 - 1e-6
    both = F.col(f"{y}linked") | ((F.col(f"{x}left") >= F.col(f"{x}strong")) & (F.col(f"{y}left") >= F.col(f"{y}strong")))
    return both & (F.least(f"{x}left", f"{y}left") >= need)


def within_centres(tested: DataFrame, links: DataFrame, labels: DataFrame, sets: DataFrame, k: int, percent: int, deeper: bool = True) -> DataFrame:
    """``links`` and those that connect texts of one group: rows ``a, b`` of ``tested`` have their edits against the centre of
    group b. ``labels`` (``node, part``) tell what is known to be connected. ``deeper`` allows a centre for each two parts
    with ``SEVERAL`` texts each in a list that still meet; pairs of texts that it doesn't decide are compared one by one."""
    lists = written(edit_lists(tested, percent), "edits")
    if lists.isEmpty():
        return links
    used = None
    while True:
        placed = lists.join(labels, lists.a == labels.node, "left").select(*lists.columns, F.coalesce("part", "a").alias("part"))
        # Lists of one part are done; the others' heads are the texts with the fewest edits that were none yet.
        head = F.struct("e", "a", "na", "linked", "left", "weak", "strong", "part")
        may_head = ~F.col("linked")
        if used is not None:
            placed = placed.join(used, ["b", "a"], "left")
            may_head &= F.col("was").isNull()
        placed = written(placed, "placed")
        heads = placed.groupBy("b", "h").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.min(F.when(may_head, head)).alias("s")).where("lo <> hi").select("b", "h", "s")
        still = written(placed.join(written(heads, "heads"), ["b", "h"]), "open")
        met = still.where((F.col("part") != F.col("s.part")) & may_share("s.", "", percent))
        met = met.groupBy("b", "a", F.col("s.a").alias("head")).agg(F.count("*").alias("c"), F.min("s.e").alias("se"))
        pairs = written(met.groupBy("b", "a").agg(F.max(F.struct("c", (-F.col("se")).alias("few"), "head")).alias("x")).select("b", "a", F.col("x.head").alias("head")), "pairs")
        if pairs.isEmpty():
            break
        linked = verified(written(pairs.select("a", F.col("head").alias("b")).distinct(), "pairs"), sets, k, percent).select("a", "b")
        if linked.isEmpty():
            break
        links = links.union(linked)
        labels = written(joined(labels, linked), "labels")
        heads = pairs.select("b", F.col("head").alias("a"), F.lit(1).alias("was")).distinct()
        used = written(heads if used is None else used.union(heads).distinct(), "used")
    # What is left are members of different parts. Of parts with several texts in a list, some meet in very many pairs.
    still = still.drop("s")
    done = F.lit(False)
    if deeper:
        large = written(still.groupBy("b", "h", "part").agg(F.count("*").alias("m")).where(F.col("m") >= SEVERAL), "large")
        x, y = large.alias("x"), large.alias("y")
        meet = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.part") != F.col("y.part")))
        meet = written(meet.select("x.b", "x.h", "x.part", F.least("x.part", "y.part").alias("lo"), F.greatest("x.part", "y.part").alias("hi")), "meet")
        deeper = not meet.isEmpty()
    if deeper:
        both = still.join(meet, ["b", "h", "part"]).groupBy("lo", "hi", "part", "a").agg(F.min("e").alias("e"), F.min("linked").alias("linked"))
        both = written(both, "both")
        centres = written(both.where("not linked").groupBy("lo", "hi").agg(F.min(F.struct("e", "a"))["a"].alias("b")), "centres")
        both = both.join(centres, ["lo", "hi"])
        members = written(both.where("a <> b").select("a", "b", F.struct("lo", "hi").alias("two")), "pairs")
        again = verified(written(members.select("a", "b").distinct(), "pairs"), sets, k, percent, edits=True)
        linked = again.where("linked").select("a", "b")
        again = again.join(members, ["a", "b"]).select("a", F.col("two").alias("b"), "na", "nb", "linked", "edits")
        links = within_centres(again, links.union(linked), written(joined(labels, linked), "labels"), sets, k, percent, deeper=False)
        # Decided are pairs of which both texts were compared with the centre of their parts: a text may also be in lists without it.
        other = F.when(F.col("part") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
        seen = written(both.groupBy("a").agg(F.collect_set(other).alias("seen")), "seen")
        still = still.join(seen, "a", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
        done = F.array_contains("x.seen", F.col("y.part")) & F.array_contains("y.seen", F.col("x.part"))
    apart = (F.col("x.b") == F.col("y.b")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.part") != F.col("y.part")) & ~done & may_share("x.", "y.", percent)
    strong = still.where("not linked and left >= strong")
    pairs = still.where("not linked").alias("x").join(still.where("linked").alias("y"), apart).select("x.a", F.col("y.a").alias("b"))
    pairs = pairs.union(strong.alias("x").join(strong.alias("y"), apart & (F.col("x.a") < F.col("y.a"))).select("x.a", F.col("y.a").alias("b"))).distinct()
    pairs = written(pairs, "pairs")
    return links if pairs.isEmpty() else links.union(verified(pairs, sets, k, percent).select("a", "b"))


def postings(nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """``value, id, n, score, left`` for the rarest values of each sketch (``id, n, sketch``) that other sketches have too;
    ``left`` counts the sketch's values from this one on, in order of rarity."""
    every = nodes.select("id", "n", F.explode("sketch").alias("value"))
    # Written, so that both sides of the join come from shuffles and a value of very many sketches can be split.
    often = written(every.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "often")
    s, full = F.least("n", F.lit(k)), F.ceil(F.col("n") * percent / 100)
    # A set that, with any partner large enough to link, stays below k is known whole: its share of t is exact.
    least = F.when(F.col("n") * 100 < k * percent, full).otherwise(F.lit(shared_least(k, percent)))
    by_id = every.join(often, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("x"), F.avg("df").alias("mean"))
    take = F.greatest(F.lit(0), F.size("x") - least + 1).cast("int")
    out = by_id.select("id", "n", (F.col("mean") * F.size("x") / s).alias("score"), F.size("x").alias("common"), F.posexplode(F.slice("x", F.lit(1), take)).alias("pos", "v"))
    return out.select("v.value", "id", "n", "score", (F.col("common") - F.col("pos")).alias("left"))


def may_link(x: str, y: str, k: int, percent: int) -> Column:
    """Length and positional bounds for two members of a list: columns ``<x>n, <x>left`` and ``<y>n, <y>left``."""
    a, b = F.col(f"{x}n"), F.col(f"{y}n")
    whole = (a < k) & (b < k)
    need = F.when(whole, F.ceil((a + b) * percent / (100 + percent))).otherwise(F.lit(shared_least(k, percent)))
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent) & (F.least(f"{x}left", f"{y}left") >= need)


def near_links(docs: DataFrame, nodes: DataFrame, size: int = SHINGLE, percent: int = 75, k: int = SKETCH) -> DataFrame:
    """Links ``a, b`` that connect whatever is connected by similarity, between rows of ``nodes`` (``id, n, sketch``).

    ``docs`` (``id, text``) holds the texts. Not all links are returned: members of one component are not compared again.
    ``nodes`` is a table from ``written``; it is deleted when its values are listed.
    """
    lists = written(postings(nodes, k, percent), "lists")
    discard(nodes)
    centre = F.max(F.struct("score", (-F.col("id")).alias("neg"), "n", "left")).alias("c")
    heads = written(lists.groupBy("value").agg(F.count("*").alias("m"), centre).where("m > 1").select("value", "c"), "heads")
    lists = lists.join(heads, "value").select("value", "id", "n", "score", "left", (-F.col("c.neg")).alias("b"), F.col("c.score").alias("cs"), F.col("c.n").alias("c_n"), F.col("c.left").alias("c_left"))
    lists = written(lists, "lists")
    sets = sets_of(docs, written(lists.select("id").distinct(), "wanted"), size)
    stars = lists.where((F.col("id") != F.col("b")) & may_link("", "c_", k, percent)).groupBy("id", "b").agg(F.count("*").alias("c"), F.max("cs").alias("cs"))
    first = written(stars.groupBy("id").agg(F.max(F.struct("c", "cs", "b")).alias("x")).select(F.col("id").alias("a"), "x.b", "x.cs"), "pairs")
    tested = verified(first.select("a", "b"), sets, k, percent, edits=True)
    links = written(tested.where("linked").select("a", "b"), "links")
    # Parts: a text is with its centre, and with the centre of that if it has one.
    up = links.select(F.col("a").alias("b"), F.col("b").alias("up"))
    labels = links.join(up, "b", "left").select(F.col("a").alias("node"), F.coalesce("up", "b").alias("part"))
    # Lists that still hold several parts. Linked sets are in one range of sizes or in two that are neighbours, and a list's
    # centre is, of the centres that its members have, that with the highest score.
    own = first.select(F.col("a").alias("id"), F.col("b").alias("own"), F.col("cs").alias("own_cs"))
    labels = written(own.select(F.col("id").alias("node"), "own", "own_cs").join(labels, "node", "left"), "labels")
    span = F.floor(F.log("n") / math.log(100 / percent))
    placed = lists.join(labels, lists.id == labels.node, "left").select("value", "id", "n", F.coalesce("part", "id").alias("part"), F.coalesce("own", "id").alias("own"), F.coalesce("own_cs", "score").alias("own_cs"))
    ranged = written(placed.withColumn("range", F.explode(F.array(span, span + 1))), "ranges")
    groups = ranged.groupBy("value", "range").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max(F.struct("own_cs", "own"))["own"].alias("b")).where("lo <> hi")
    members = written(ranged.join(written(groups.select("value", "range", "b"), "open"), ["value", "range"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct(), "members")
    if members.isEmpty():
        discard(sets)
        return links
    known = tested.join(members, ["a", "b"], "left_semi")
    fresh_pairs = written(members.join(first, ["a", "b"], "left_anti"), "pairs")
    again = verified(fresh_pairs, sets, k, percent, edits=True)
    linked = again.where("linked").select("a", "b")
    labels = written(joined(labels.where("part is not null").select("node", "part"), linked), "labels")
    links = within_centres(written(known.union(again), "stars"), links.union(linked), labels, sets, k, percent)
    discard(sets)
    return links


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The full sets of all wanted ids, written: texts are read once, whatever is compared. A bitmap of bounded size keeps most
    other texts from being hashed; the join then leaves exactly the wanted ids, and it shuffles sets, not texts."""
    bits = bitmap(wanted.select(F.xxhash64("id").alias("shingle")))
    return written(full_sets(docs, size, bits).join(wanted, "id", "left_semi"), "sets")


def labelled(plain: DataFrame, made: DataFrame, size: int, percent: int, k: int) -> DataFrame:
    """``id, n, label`` for every row of ``made`` (sketches of ``plain``): the smallest id reachable. Equal ids have equal texts.
    ``made`` is a table from ``written``; it is deleted when the sketches of the classes have been taken from it."""
    known = "n > 0 and id is not null"
    keys = written(made.select("id", "n", "k1", "k2"), "keys")
    classes = keys.where(known).groupBy("k1", "k2").agg(F.min("id").alias("rep"))
    nodes = made.alias("m").join(classes.alias("c"), (F.col("m.id") == F.col("c.rep")) & (F.col("m.k1") == F.col("c.k1")) & (F.col("m.k2") == F.col("c.k2")))
    nodes = written(nodes.select("m.id", "m.n", "m.sketch", "m.k1", "m.k2").dropDuplicates(["id", "k1", "k2"]).select("id", "n", "sketch"), "nodes")
    discard(made)
    labels = components(near_links(plain, nodes, size, percent, k))
    # Written, so that both sides of the last join come from shuffles: a class with very many copies can be split.
    placed = written(classes.join(labels, classes.rep == labels.node, "left").select("k1", "k2", F.coalesce("label", "rep").alias("label")), "classes")
    rows = keys.where(known).join(placed, ["k1", "k2"], "left").select("id", "n", "label")
    return rows.union(keys.where(f"not ({known})").select("id", "n", F.col("id").alias("label")))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 75, k: int = SKETCH) -> DataFrame:
    """Near-duplicate components: ``<id>, n_shingles, component_id, kept``, one row per row of ``docs``.

    Two documents are linked when ``100 * |intersection| >= percent * |union|`` of their sets of ``size``-word shingles
    (words are runs without ASCII white space, A-Z lower-cased; fewer words make one shingle). ``component_id`` is the
    smallest id reachable through links, itself included; ``kept`` marks its row. Null, empty and blank texts have no
    shingles and link with nothing. A null id links with nothing: its component is null and it is kept. Repeated rows
    stay rows, all with the same result; rows that share an id but not the text are linked each by its own text. Texts of
    any length are read whole. Other columns, whatever their names, are not read.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    made = written(sketches(plain, size, k), "sketches")
    several = made.where("id is not null").groupBy("id").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi")
    if several.isEmpty():
        rows = labelled(plain, made, size, percent, k).select("id", "n", F.col("label").alias("component_id"))
    else:  # ids that stand for several texts: link by a key of both, and take the smallest id of each component
        keyed = plain.select(F.when(F.col("id").isNotNull(), F.xxhash64("id", "text")).alias("id"), "text", F.col("id").alias("own"))
        discard(made)
        made = written(sketches(keyed.select("id", "text"), size, k), "sketches")
        owner = keyed.where("id is not null").select(F.col("id").alias("key"), "own").distinct()
        rows = written(labelled(keyed.select("id", "text"), made, size, percent, k), "rows")
        rows = rows.join(owner, rows.id == owner.key, "left").select("own", "n", "label")
        least = written(rows.groupBy("label").agg(F.min("own").alias("component_id")), "least")
        rows = rows.join(least, "label", "left").select(F.col("own").alias("id"), "n", "component_id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
