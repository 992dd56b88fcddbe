"""Full hierarchies from parent-child rows (problem 5).

Nodes with exactly one parent form trees that hang on heads: nodes with no parent or with several.
Inside the trees everything comes from Euler tours:

1. Peeling. After k doublings of the parent pointer the 2^k-th ancestors are known, and the nodes
   that are 2^k-th ancestor of none are those that 2^k rounds of peeling leaves would take off.
   What is never peeled among nodes that reach no head is exactly the cycles of single parents.
2. Tours. Each tree's tour enters and leaves every node; its list is ranked in parallel: pointer
   doubling stops at sparse rulers (picked by hash) and at the lists' ends, the far shorter lists of
   rulers are ranked the same way, and so on; only last lists of few rulers (their size is checked) go
   to one task. A list that has no ruler left is ranked and goes no further, however many lists there are.
3. Intervals. Entry places count in preorder, so a node's interval is [entry, entry + size - 1].
   An interval is cut into aligned blocks of powers of two, and each entry lies in one block of
   each size: ancestors and descendants meet in an equality join whose result is the answer, with
   no range scan and no tree as a unit of work.

Heads with several parents join the trees to a small graph of heads. There, peeling from the roots
finds the heads under no cycle, and forward-backward colouring the heads that lie on one. All ways
from the roots are then laid over the trees.

A parent's children are linked within salted groups, so a parent with a third of all rows has its
children linked by many tasks. Only salted groups' ends and heads are ever handled per parent.
Tables of each round are written to the shared folder; rounds grow with the logarithm of the depth
of trees, and with the number of several-parent nodes on a way.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapidar.runtime import Scratch

SALTS = 64
"""Groups into which a parent's children are dealt."""
RULER_SPACING = 16
"""One list entry in so many is a ruler."""
SALT_LEVEL = 16
LAST_LIST = 20_000
"""A list of rulers of at most so many entries is ranked by one task; the tours themselves never are."""


def clean_edges(df: DataFrame, id: str = "id", parents: str = "parent_ids") -> tuple[DataFrame, DataFrame]:
    """(id) nodes and (id, parent) edges: entries trimmed and counted once; nulls and parents that no row has don't count."""
    rows = df.select(F.col(id).alias("id"), F.col(parents).alias("parents")).where(F.col("id").isNotNull())
    nodes = rows.select("id").distinct()
    stated = rows.select("id", F.explode("parents").alias("p")).select("id", F.regexp_replace("p", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias("parent"))
    return nodes, stated.where("parent is not null").distinct().join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent")


class Hierarchy:
    """All parts of the analysis of one set of parent-child rows; frames are read back from the shared folder.

    Rows with a null id count for nothing, rows of the same id together state its parents. Null and
    unknown parents don't count, a node may be its own parent (a cycle of one). An empty table gives
    empty results; other columns are ignored.
    """

    def __init__(self, df: DataFrame, id: str = "id", parents: str = "parent_ids"):
        self.s = Scratch(df.sparkSession)
        keep = self.s.keep
        nodes, edges = clean_edges(df, id, parents)
        self.edges = keep(edges, "edges")
        per_node = self.edges.groupBy("id").agg(F.count("*").alias("n"), F.min("parent").alias("parent"))
        self.nodes = keep(
            nodes.join(per_node, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("parent")).alias("parent")), "nodes"
        )
        self._peel()
        self._tours()
        self._heads()

    # -- step 1

    def _peel(self) -> None:
        """hang (id, parent): nodes of trees, heads with parent null. loops (id, parent, on): nodes on or below cycles of single parents."""
        keep = self.s.keep
        step = keep(self.nodes.where("parent is not null").select("id", F.col("parent").alias("up")), "up")
        # pointers that end at a head leave the table; when none left in a round, none of the rest ever will
        left = step.count()
        heads = self.nodes.where("parent is null").select(F.col("id").alias("up"))
        step = keep(step.join(heads, "up", "left_anti"), "up")
        while left:
            # double: the up of the up; where the up itself has left the table, its chain ends at a head
            above = step.select(F.col("id").alias("up"), F.col("up").alias("up2"))
            step, now = self.s.counted(step.join(above, "up").select("id", F.col("up2").alias("up")), "up")
            if now == left:
                break
            left = now
        self.loops = None
        if left:
            # every pointer stays inside now; images shrink to the cycles
            image, size = self.s.counted(step.select(F.col("up").alias("id")).distinct(), "image")
            while True:
                above = step.select(F.col("id").alias("up"), F.col("up").alias("up2"))
                step = keep(step.join(above, "up").select("id", F.col("up2").alias("up")), "up")
                image, now = self.s.counted(step.select(F.col("up").alias("id")).distinct(), "image")
                if now == size:
                    break
                size = now
            self.loops = keep(step.select("id").join(image.withColumn("on", F.lit(True)), "id", "left").select("id", F.coalesce("on", F.lit(False)).alias("on")), "loops")
        hang = self.nodes.select("id", "parent")
        self.hang = keep(hang.join(self.loops, "id", "left_anti") if self.loops is not None else hang, "hang")
        self.s.drop("up", "image")

    # -- step 2

    def _tours(self) -> None:
        """tree (id, head, entry, low, size, depth, total): the node's entry and its subtree's lowest, counted from the end of the tree's tour; depth from 0 at the head."""
        keep = self.s.keep
        kids = self.hang.where("parent is not null").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        group = Window.partitionBy("parent", "salt").orderBy("id")
        linked = kids.withColumn("next", F.lead("id").over(group))
        ends = kids.groupBy("parent", "salt").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        across = Window.partitionBy("parent").orderBy("salt")  # at most SALTS rows
        ends = keep(ends.withColumn("follow", F.lead("first").over(across)).withColumn("k", F.row_number().over(across)), "ends")
        follow = ends.where("follow is not null").select(F.col("last").alias("id"), "follow")
        first = ends.where("k = 1").select(F.col("parent").alias("id"), F.col("first").alias("child"))
        # entries: +id on entering, -id on leaving a node that has children; a leaf is left at once
        kin = keep(
            self.hang.join(linked.select("id", "next"), "id", "left").join(follow, "id", "left").join(first, "id", "left")
            .select("id", "parent", F.coalesce("next", "follow").alias("next"), "child"),
            "kin",
        )
        onward = F.when(F.col("next").isNotNull(), F.concat(F.lit("+"), "next")).when(F.col("parent").isNotNull(), F.concat(F.lit("-"), "parent"))
        enter = kin.select(
            F.concat(F.lit("+"), "id").alias("e"),
            F.when(F.col("child").isNotNull(), F.concat(F.lit("+"), "child")).otherwise(onward).alias("to"),
            F.lit(1).cast("bigint").alias("n"),
            F.when(F.col("child").isNotNull(), 1).otherwise(0).cast("bigint").alias("d"),
        )
        leave = kin.where("child is not null").select(F.concat(F.lit("-"), "id").alias("e"), onward.alias("to"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("d"))
        links = keep(enter.unionByName(leave).withColumn("tail", F.when(F.col("to").isNull(), F.col("e"))), "links")
        ranked = self._rank(links, 0)
        # after_*: sums from an entry to its list's end. Counted from the end, a node's entry is after_n - 1, its
        # subtree reaches down to what follows its leaving, and depths come with the sign changed
        enter_at = ranked.where("e like '+%'").select(F.substr("e", F.lit(2)).alias("id"), F.substr("tail", F.lit(2)).alias("head"), F.col("after_n").alias("n_in"), (-F.col("after_d")).alias("depth"))
        leave_at = ranked.where("e like '-%'").select(F.substr("e", F.lit(2)).alias("id"), F.col("after_n").alias("n_out"))
        flat = enter_at.join(leave_at, "id", "left").select(
            "id", "head", (F.col("n_in") - 1).alias("entry"), F.coalesce("n_out", F.col("n_in") - 1).alias("low"), "depth"
        )
        flat = keep(flat.withColumn("size", F.col("entry") - F.col("low") + 1), "flat")
        self.tree = keep(flat.join(flat.groupBy("head").agg(F.count("*").alias("total")), "head"), "tree")
        self.s.drop("links", "rank0-all", "kin", "ends", "flat")

    def _rank(self, links: DataFrame, level: int) -> DataFrame:
        """links (e, to, n, d, tail), lists that end where to is null, there with the tail to be named → (e, tail, after_n, after_d): the list's tail and the sums from e to its end."""
        keep, name = self.s.keep, f"rank{level}"
        if level and links.count() <= LAST_LIST:
            return links.groupBy(F.lit(0).alias("one")).applyInPandas(_rank_block, "e string, tail string, after_n bigint, after_d bigint")
        # one entry in RULER_SPACING is a ruler; the others run to the next ruler or to the list's end, which names the tail
        last = F.col("to").isNull()
        ruler = ~last & (F.pmod(F.xxhash64("e", F.lit(level)), F.lit(RULER_SPACING)) == 0)
        none = F.lit(None).cast("string")
        step, waiting = self.s.counted(
            links.select("e", F.when(last | ruler, F.col("e")).alias("at"), F.when(~ruler, F.col("to")).alias("to"), F.when(ruler, 0).otherwise(F.col("n")).alias("n"), F.when(ruler, 0).otherwise(F.col("d")).alias("d"), "tail"),
            f"{name}-step0", F.col("at").isNull(),
        )
        steps = [step]
        settled = lambda: functools.reduce(DataFrame.unionByName, (x.where("at is not null").select("e", "at", "n", "d", "tail") for x in steps))
        # pointer doubling: those whose next entry is settled are settled, the rest jump. Each round's table holds only what was open before it
        while waiting:
            open_ = step.where("at is null").select("e", "to", "n", "d")
            ahead = settled().select(F.col("e").alias("to"), F.col("at").alias("at2"), none.alias("to2"), F.col("n").alias("n2"), F.col("d").alias("d2"), "tail")
            ahead = ahead.unionByName(open_.select(F.col("e").alias("to"), none.alias("at2"), F.col("to").alias("to2"), F.col("n").alias("n2"), F.col("d").alias("d2"), none.alias("tail")))
            jumped = open_.join(ahead, "to").select("e", F.col("at2").alias("at"), F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), "tail")
            step, waiting = self.s.counted(jumped, f"{name}-step{len(steps)}", F.col("at").isNull())
            steps.append(step)
        # the lists of rulers: each stands for its own entry and the run after it, the last of a list for all that follows
        done = settled()
        runs = done.select(F.col("e").alias("to"), "at", F.col("n").alias("n2"), F.col("d").alias("d2"), "tail")
        short = keep(
            links.where(ruler).drop("tail").join(runs, "to").select("e", F.when(F.col("tail").isNull(), F.col("at")).alias("to"), (F.col("n") + F.col("n2")).alias("n"), (F.col("d") + F.col("d2")).alias("d"), "tail"),
            name + "-short",
        )
        top = keep(self._rank(short, level + 1).withColumnRenamed("e", "at"), name + "-top")
        before = done.where("tail is null").drop("tail").join(top, "at").select("e", "tail", (F.col("n") + F.col("after_n")).alias("after_n"), (F.col("d") + F.col("after_d")).alias("after_d"))
        out = keep(done.where("tail is not null").select("e", "tail", F.col("n").alias("after_n"), F.col("d").alias("after_d")).unionByName(before), name + "-all")
        self.s.drop(*(f"{name}-step{i}" for i in range(len(steps))), name + "-short", name + "-top", f"rank{level + 1}-all")
        return out

    # -- step 3

    def within(self, tree: DataFrame, ancestors: DataFrame | None = None) -> DataFrame:
        """(ancestor, a_depth, id, depth): each node of tree with each of its ancestors-or-self that has children, in its own tree.

        ancestors restricts the upper side. Both sides meet in aligned blocks of entries, by (head, size of block, block).
        """
        wide = (ancestors if ancestors is not None else tree).where("size > 1")
        end = F.col("entry") + 1
        # cut [low, entry] into the largest aligned blocks, from below; at most two of each size
        blocks = F.aggregate(
            F.sequence(F.lit(0), 2 * F.length(F.bin("size")) + 1),
            F.struct(F.col("low").alias("at"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out")),
            lambda acc, _: F.when(acc["at"] >= end, acc).otherwise(_cut(acc, end)),
            lambda acc: acc["out"],
        )
        # a block of more than 2^SALT_LEVEL entries has its points dealt into groups of about that many
        groups = lambda level: F.call_function("shiftleft", F.lit(1), F.greatest(level - SALT_LEVEL, F.lit(0)))
        upper = wide.select("head", F.col("id").alias("ancestor"), F.col("depth").alias("a_depth"), F.inline(blocks))
        upper = upper.withColumn("salt", F.explode(F.sequence(F.lit(0), groups(F.col("level")) - 1)))
        points = tree.select("head", "id", "depth", "entry", F.explode(F.sequence(F.lit(0), F.length(F.bin("total")) - 1)).alias("level"))
        points = points.select(
            "head", "id", "depth", "level", F.call_function("shiftright", "entry", "level").alias("block"), F.pmod(F.hash("id"), groups(F.col("level"))).alias("salt")
        )
        return upper.join(points, ["head", "level", "block", "salt"]).select("ancestor", "a_depth", "id", "depth")

    # -- the graph of heads

    def _heads(self) -> None:
        """states (id, state): cycle, below or clean of every node; grafts (head, parent, from_head) of heads with several parents."""
        keep = self.s.keep
        many = self.nodes.where("n > 1").select("id")
        joints = self.edges.join(many, "id", "left_semi")
        place = self.tree.select(F.col("id").alias("parent"), F.col("head").alias("from_head"))
        # a parent on or below a cycle of single parents has no head: from_head null
        self.grafts = keep(joints.join(place, "parent", "left").select(F.col("id").alias("head"), "parent", "from_head"), "grafts")
        links = keep(self.grafts.where("from_head is not null").select(F.col("from_head").alias("a"), F.col("head").alias("b")).distinct(), "links2")
        stuck, n = self.s.counted(many.select(F.col("id").alias("b")), "stuck")  # heads not yet known to be clean
        tainted = self.grafts.where("from_head is null").select(F.col("head").alias("b")).distinct()
        # peel from the roots: a head is clean once no link comes from a stuck head and no parent is tainted
        while n:
            held = links.join(stuck.select(F.col("b").alias("a")), "a", "left_semi").select("b").union(tainted).distinct()
            stuck, now = self.s.counted(stuck.join(held, "b", "left_semi"), "stuck")
            if now == n:
                break
            n = now
        self.stuck = stuck
        on = self._on_cycle(links, stuck) if n else None
        on_nodes = None
        if on is not None:
            # (a, b) within one component: the parents in a's tree that lead to b, and their ancestors in the tree
            inner = self.grafts.join(on.select(F.col("b").alias("head"), "c"), "head").join(on.select(F.col("b").alias("from_head"), F.col("c").alias("c2")), "from_head").where("c = c2")
            leads = self.tree.join(inner.select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
            touched = self.tree.join(leads.select("head").distinct(), "head", "left_semi")
            on_nodes = keep(self.within(leads, touched).select(F.col("ancestor").alias("id")).union(leads.select("id")).distinct(), "on")
        bad_heads = stuck.select(F.col("b").alias("head"), F.lit(True).alias("bad"))
        states = self.tree.join(bad_heads, "head", "left").select("id", "head", F.coalesce("bad", F.lit(False)).alias("bad"))
        if on_nodes is not None:
            states = states.join(on_nodes.withColumn("on", F.lit(True)), "id", "left")
            states = states.select("id", F.when(F.col("on"), "cycle").when(F.col("bad"), "below").otherwise("clean").alias("state"))
        else:
            states = states.select("id", F.when(F.col("bad"), "below").otherwise("clean").alias("state"))
        if self.loops is not None:
            states = states.unionByName(self.loops.select("id", F.when(F.col("on"), "cycle").otherwise("below").alias("state")))
        self.states = keep(states, "states")

    def _on_cycle(self, links: DataFrame, stuck: DataFrame) -> DataFrame | None:
        """(b, c): stuck heads that are their own ancestors, with the component they lie in."""
        keep = self.s.keep
        inside = links.join(stuck.select(F.col("b").alias("a")), "a", "left_semi").join(stuck, "b", "left_semi").select("a", "b")
        found = [keep(inside.where("a = b").select("b", F.col("b").alias("c")).distinct(), "self")]
        live = keep(inside.where("a <> b"), "live")
        round_ = 0
        while True:
            # trim heads that no live link enters or leaves: they lie on no cycle
            n = live.count()
            while n:
                live, now = self.s.counted(live.join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "live")
                if now == n:
                    break
                n = now
            if not n:
                break
            # forward: the greatest id that reaches a head; backward within that colour: its component
            colour = keep(live.select(F.col("a").alias("b")).union(live.select("b")).distinct().withColumn("c", F.col("b")), "colour")
            while True:
                reach = live.join(colour.select(F.col("b").alias("a"), F.col("c").alias("c2")), "a").groupBy("b").agg(F.max("c2").alias("c2"))
                new = colour.join(reach, "b", "left").select("b", F.greatest("c", F.coalesce("c2", "c")).alias("c"), (F.col("c2") > F.col("c")).alias("moved"))
                new, moved = self.s.counted(new, "colour", F.coalesce("moved", F.lit(False)))
                colour = new.select("b", "c")
                if not moved:
                    break
            same = live.join(colour.select(F.col("b").alias("a"), "c"), "a").join(colour.select("b", F.col("c").alias("c2")), "b").where("c = c2").select("a", "b", "c")
            same = keep(same, "same")
            member = keep(colour.where("b = c"), "member")
            size = member.count()
            while True:
                more = same.join(member.select("b", "c"), ["b", "c"], "left_semi").select(F.col("a").alias("b"), "c")
                member, now = self.s.counted(member.union(more).distinct(), "member")
                if now == size:
                    break
                size = now
            alone = member.groupBy("c").count().where("count > 1").select("c")
            part = keep(member.join(alone, "c", "left_semi").select("b", "c"), f"component{round_}")
            found.append(part)
            gone = member.select(F.col("b").alias("x"))
            live = keep(live.join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti").select("a", "b"), "live")
            round_ += 1
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        # a head with a link to itself may also lie in a greater component
        out = keep(out.groupBy("b").agg(F.max(F.when(F.col("c") != F.col("b"), F.col("c"))).alias("c")).select("b", F.coalesce("c", "b").alias("c")), "cyclic")
        return None if out.isEmpty() else out

    # -- results

    def ways(self) -> DataFrame:
        """(id, way array<string>): each way from a root down to a node under no cycle."""
        keep = self.s.keep
        clean_tree = keep(self.tree.join(self.stuck.select(F.col("b").alias("head")), "head", "left_anti"), "clean")
        # ids from the head (exclusive) to the node, in order of depth
        pairs = self.within(clean_tree).where("ancestor <> id and a_depth > 0")
        above = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("a_depth", "ancestor"))).alias("line"))
        none = F.array().cast("array<string>")
        rel = F.concat(F.coalesce(F.transform("line", lambda x: x["ancestor"]), none), F.when(F.col("depth") > 0, F.array("id")).otherwise(none))
        local = keep(clean_tree.join(above, "id", "left").select("id", "head", rel.alias("rel")), "local")
        # ways to heads: roots first, then over the grafts, as many rounds as grafts lie on one way
        ways = [keep(self.nodes.where("n = 0").select(F.col("id").alias("head"), F.array("id").alias("way")), "ways0")]
        hops = keep(self.grafts.join(local.select(F.col("id").alias("parent"), "rel"), "parent").join(self.stuck.select(F.col("b").alias("head")), "head", "left_anti").select("from_head", "head", "rel"), "hops")
        while True:
            last = ways[-1].select(F.col("head").alias("from_head"), "way")
            new, n = self.s.counted(last.join(hops, "from_head").select("head", F.concat("way", "rel", F.array("head")).alias("way")), f"ways{len(ways)}")
            if not n:
                break
            ways.append(new)
        every = ways[0]
        for w in ways[1:]:
            every = every.unionByName(w)
        return local.join(every, "head").select("id", F.concat("way", "rel").alias("way"))

    def paths(self) -> DataFrame:
        """(id, state, root_id, depth, path): a row for each way from a root to a node under no cycle; one row for every other node."""
        clean = self.ways().select(
            "id", F.lit("path").alias("state"), F.col("way")[0].alias("root_id"), (F.size("way") - 1).cast("bigint").alias("depth"), F.array_join("way", "/").alias("path")
        )
        rest = self.states.where("state <> 'clean'").select("id", "state", F.lit("").alias("root_id"), F.lit(-1).cast("bigint").alias("depth"), F.lit("").alias("path"))
        return clean.unionByName(rest)

    def descendants(self) -> DataFrame:
        """(id, descendant): every node with all nodes below it, once for each pair, over all parents, on and below cycles too. A node on a cycle is its own descendant.

        Pairs within trees come from the intervals. Between trees, and through cycles of single parents, they come
        from the closure of the heads' links, which doubles the length of ways covered with each round.
        """
        keep = self.s.keep
        # places (id, head) of all nodes: those on cycles are heads of their own, those below are reached by their own links
        loose = self.loops.select("id", F.col("id").alias("head")) if self.loops is not None else self.tree.select("id", "head").limit(0)
        inside = keep(self.within(self.tree).where("ancestor <> id").select(F.col("ancestor").alias("id"), F.col("id").alias("descendant")), "inside")
        # links (a, b): head b hangs below some node of a's tree
        apart = self.edges.join(self.nodes.where("n > 1").select("id"), "id", "left_semi")
        if self.loops is not None:
            apart = apart.unionByName(self.edges.join(self.loops.select("id"), "id", "left_semi")).distinct()
        place = self.tree.select("id", "head").unionByName(loose)
        joints = keep(apart.join(place.select(F.col("id").alias("parent"), F.col("head").alias("a")), "parent").select("parent", "a", F.col("id").alias("b")), "joints")
        reach, n = self.s.counted(joints.select("a", "b").distinct(), "reach")
        while n:
            longer = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
            reach, now = self.s.counted(reach.union(longer).distinct(), "reach")
            if now == n:
                break
            n = now
        # heads met from a node: those that hang on it or on nodes below it in its tree, and whatever these reach
        hung = joints.select("parent", "b").distinct()
        met = hung.select(F.col("parent").alias("id"), "b").union(inside.select("id", F.col("descendant").alias("parent")).join(hung, "parent").select("id", "b")).distinct()
        met = keep(met, "met")
        met = met.union(met.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("id", F.col("c").alias("b"))).distinct()
        across = met.join(place.select(F.col("head").alias("b"), F.col("id").alias("descendant")), "b").select("id", "descendant")
        return inside.union(across).distinct()


def _cut(acc: Column, end: Column) -> Column:
    """Takes the largest aligned block that starts at acc.at and ends within end."""
    at = acc["at"]
    align = F.when(at == 0, F.lit(62)).otherwise(F.bit_count(at.bitwiseAND(-at) - 1))
    level = F.least(align, F.length(F.bin(end - at)) - 1)
    block = F.struct(level.alias("level"), F.call_function("shiftright", at, level).alias("block"))
    after = at + F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
    return F.struct(after.alias("at"), F.concat(acc["out"], F.array(block)).alias("out"))


def _rank_block(one: pd.DataFrame) -> pd.DataFrame:
    """Ranks whole lists of bounded total length by pointer doubling in memory."""
    names = pd.Index(one["e"])
    end = one["to"].isna().to_numpy()
    nxt = np.arange(len(one))
    nxt[~end] = names.get_indexer(one["to"][~end])
    own_n, own_d = one["n"].to_numpy(), one["d"].to_numpy()
    sum_n, sum_d = np.where(end, 0, own_n), np.where(end, 0, own_d)
    while not end[nxt].all():
        sum_n, sum_d = sum_n + sum_n[nxt], sum_d + sum_d[nxt]
        nxt = nxt[nxt]
    # the end's own weight counts once
    return pd.DataFrame({"e": names, "tail": one["tail"].to_numpy()[nxt], "after_n": sum_n + own_n[nxt], "after_d": sum_d + own_d[nxt]})
