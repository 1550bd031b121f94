"""Reply edges and thread walks.

messages: list_id, pos, msgnum, msgid, inreplyto, subject, date. Edges: list_id, parent_msgnum,
child_msgnum, maybe_reply, kind, seq (order of discovery: header, subject, quoted, each by child).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.mail import bracketed_ids, normalize_msgid
from ..functions.text import ascii_lower, unre
from .ranking import written

LOOK_BACK = 500
#: Edges of a later pass come after all of an earlier one.
PASS = 1 << 40
MAX_DEPTH = 50
EDGES = ("list_id", "parent_msgnum", "child_msgnum", "maybe_reply", "kind", "seq")


def _holders(messages: DataFrame, key) -> DataFrame:
    """The last message of each id; an aggregate, so that a repeated id is no hot task."""
    keyed = messages.select("list_id", key.alias("_key"), "pos", "msgnum").filter("_key <> ''")
    return keyed.groupBy("list_id", "_key").agg(F.max_by("msgnum", "pos").alias("parent_msgnum"))


def header_edges(messages: DataFrame) -> DataFrame:
    """Reply to parent by Message-ID; the parent may come later, and a self-reference is an edge."""
    children = messages.filter(F.col("inreplyto").isNotNull()).select("list_id", normalize_msgid(F.col("inreplyto")).alias("_key"), "pos", "msgnum")
    found = children.join(_holders(messages, normalize_msgid(F.col("msgid"))), ["list_id", "_key"])
    return found.select("list_id", "parent_msgnum", F.col("msgnum").alias("child_msgnum"), F.lit(0).alias("maybe_reply"),
                        F.lit("header").alias("kind"), F.col("pos").cast("bigint").alias("seq"))


def unresolved_replies(messages: DataFrame) -> DataFrame:
    """Replies whose parent isn't in the list."""
    children = messages.filter(F.col("inreplyto").isNotNull()).withColumn("_key", normalize_msgid(F.col("inreplyto")))
    return children.join(_holders(messages, normalize_msgid(F.col("msgid"))), ["list_id", "_key"], "left_anti").drop("_key")


def subject_edges(messages: DataFrame, look_back: int = LOOK_BACK, strict_prefix: bool = False) -> DataFrame:
    """Replies without In-Reply-To to a message of the same bare subject among the look_back before
    them: the earliest whose subject is bare itself, else the earliest.

    The frame is bounded, so positions are cut into ranges, each with the look_back rows before it;
    one subject with a third of all messages is many tasks.
    """
    size = max(20 * look_back, 10_000)
    bare = unre(F.col("subject"), strict_prefix)
    rows = messages.filter(F.coalesce(F.col("subject"), F.lit("")) != "").select(
        "list_id", "pos", "msgnum", "inreplyto", bare.alias("_bare"), (F.octet_length(bare) < F.octet_length("subject")).alias("_re"))
    rows = rows.filter("_bare <> ''").withColumn("_key", ascii_lower(F.col("_bare")))
    own = F.floor(F.col("pos") / size)
    halo = F.when(F.col("pos") % size >= size - look_back, F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("_range", F.explode(halo))
    before = W.partitionBy("list_id", "_key", "_range").orderBy("pos").rangeBetween(-look_back, -1)
    best = F.min(F.struct(F.col("_re").cast("int"), F.col("pos"), F.col("msgnum"))).over(before)
    found = spread.withColumn("_best", best).filter((own == F.col("_range")) & F.col("inreplyto").isNull() & F.col("_re") & F.col("_best").isNotNull())
    return found.select("list_id", F.col("_best.msgnum").alias("parent_msgnum"), F.col("msgnum").alias("child_msgnum"), F.lit(1).alias("maybe_reply"),
                        F.lit("subject").alias("kind"), (F.lit(PASS) + F.col("pos")).alias("seq"))


def quoted_edges(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """Edges to messages whose id (exactly) stands in another's text that is no attachment."""
    tokens = lines.filter(~F.col("attached")).select("list_id", F.col("msgnum").alias("child_msgnum"), "line_no", F.posexplode(bracketed_ids(F.col("line"))).alias("_at", "_key"))
    found = tokens.join(_holders(messages, F.col("msgid")), ["list_id", "_key"]).filter("parent_msgnum <> child_msgnum")
    at = messages.select("list_id", F.col("msgnum").alias("child_msgnum"), "pos")
    return found.join(at, ["list_id", "child_msgnum"]).select(
        "list_id", "parent_msgnum", "child_msgnum", F.lit(1).alias("maybe_reply"), F.lit("quoted").alias("kind"), (F.lit(2 * PASS) + F.col("pos")).cast("bigint").alias("seq"))


def reply_edges(messages: DataFrame, lines: DataFrame | None = None, look_back: int = LOOK_BACK, strict_prefix: bool = False) -> DataFrame:
    """All edges; with lines also those of quoted ids."""
    edges = header_edges(messages).unionByName(subject_edges(messages, look_back, strict_prefix))
    return edges if lines is None else edges.unionByName(quoted_edges(messages, lines))


def quoted_tokens(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """(list_id, child_msgnum, pos, key): the bracketed ids in each message's text, so that an update needs no texts."""
    tokens = lines.filter(~F.col("attached")).select("list_id", F.col("msgnum").alias("child_msgnum"), F.explode(bracketed_ids(F.col("line"))).alias("key"))
    return tokens.join(messages.select("list_id", F.col("msgnum").alias("child_msgnum"), "pos"), ["list_id", "child_msgnum"])


def _token_edges(tokens: DataFrame, holders: DataFrame) -> DataFrame:
    found = tokens.join(holders.withColumnRenamed("_key", "key"), ["list_id", "key"]).filter("parent_msgnum <> child_msgnum")
    return found.select("list_id", "parent_msgnum", "child_msgnum", F.lit(1).alias("maybe_reply"), F.lit("quoted").alias("kind"), (F.lit(2 * PASS) + F.col("pos")).cast("bigint").alias("seq"))


def edge_delta(old: DataFrame, new: DataFrame, look_back: int = LOOK_BACK, strict_prefix: bool = False,
               old_tokens: DataFrame | None = None, new_tokens: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What new messages, which come after all old ones of their lists, do to the edges: (gone, fresh).

    gone: (list_id, kind, parent_msgnum) of old parents whose id a new message has taken over; all their edges of
    that kind end. fresh: edges of new children (to new and to old parents) and of old children to new parents.
    Of the old messages only ids, and subjects in reach of the look-back, are read."""
    norm, exact = normalize_msgid(F.col("msgid")), F.col("msgid")
    own = _holders(new, norm)

    def beside(ids: DataFrame, asked: DataFrame, key) -> DataFrame:
        """The holders of the ids that are asked for: the new ones, else the old ones."""
        known = old.select("list_id", "msgid", "pos", "msgnum").withColumn("_asked", key).join(asked.select("list_id", F.col("_key").alias("_asked")).distinct(), ["list_id", "_asked"], "left_semi")
        return ids.unionByName(_holders(known, key).join(ids.select("list_id", "_key"), ["list_id", "_key"], "left_anti"))

    def of(children: DataFrame, holders: DataFrame) -> DataFrame:
        return children.join(holders, ["list_id", "_key"]).select(
            "list_id", "parent_msgnum", F.col("msgnum").alias("child_msgnum"), F.lit(0).alias("maybe_reply"), F.lit("header").alias("kind"), F.col("pos").cast("bigint").alias("seq"))

    replying = lambda m: m.filter("inreplyto IS NOT NULL").select("list_id", normalize_msgid(F.col("inreplyto")).alias("_key"), "pos", "msgnum")
    fresh = of(replying(new), beside(own, replying(new), norm)).unionByName(of(replying(old), own))
    gone = _superseded(old, own, norm, "header")
    # subjects: new rows and what lies in reach before them
    first = new.groupBy("list_id").agg(F.min("pos").alias("_first"))
    near = ["list_id", "pos", "msgnum", "inreplyto", "subject"]
    reach = old.select(*near).join(first, "list_id").filter(F.col("pos") >= F.col("_first") - look_back).select(*near)
    late = subject_edges(reach.unionByName(new.select(*near)), look_back, strict_prefix).join(first, "list_id").filter(F.col("seq") >= F.lit(PASS) + F.col("_first")).drop("_first")
    fresh = fresh.unionByName(late)
    if new_tokens is not None:
        ids = _holders(new, exact)
        fresh = fresh.unionByName(_token_edges(new_tokens, beside(ids, new_tokens.select("list_id", F.col("key").alias("_key")), exact))).unionByName(_token_edges(old_tokens, ids))
        gone = gone.unionByName(_superseded(old, ids, exact, "quoted"))
    return gone, fresh


def _superseded(old: DataFrame, ids: DataFrame, key, kind: str) -> DataFrame:
    """Old messages that have an id of a new one."""
    return old.withColumn("_key", key).join(ids.select("list_id", "_key"), ["list_id", "_key"], "left_semi").select("list_id", F.lit(kind).alias("kind"), F.col("msgnum").alias("parent_msgnum"))


def touched_messages(nodes: DataFrame, walked: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(list_id, msgnum) of all messages whose place in a walk may have changed.

    nodes: all messages, old and new; walked: the walk before (list_id, root, msgnum); edges: all edges now; changed:
    (list_id, msgnum) new messages and ends of edges that came or went. A walk's threads, joined where edges lead
    from one to another, change as a whole; a message without a thread is one of its own."""
    labels = written(nodes.select("list_id", "msgnum").join(walked.select("list_id", "msgnum", "root"), ["list_id", "msgnum"], "left").select(
        "list_id", "msgnum", F.coalesce("root", "msgnum").alias("label")))
    a = labels.select("list_id", F.col("msgnum").alias("parent_msgnum"), F.col("label").alias("_a"))
    b = labels.select("list_id", F.col("msgnum").alias("child_msgnum"), F.col("label").alias("_b"))
    between = edges.join(a, ["list_id", "parent_msgnum"]).join(b, ["list_id", "child_msgnum"]).filter("_a <> _b").select("list_id", F.col("_a").alias("parent_msgnum"), F.col("_b").alias("child_msgnum")).distinct()
    part = components(labels.select("list_id", F.col("label").alias("msgnum")).distinct(), between).select("list_id", F.col("msgnum").alias("label"), "component")
    placed = labels.join(part, ["list_id", "label"])
    hit = placed.join(changed, ["list_id", "msgnum"], "left_semi").select("list_id", "component").distinct()
    return placed.join(hit, ["list_id", "component"], "left_semi").select("list_id", "msgnum")


def children_of(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge with its child's row, in order of discovery (seq)."""
    child = messages.withColumnRenamed("msgnum", "child_msgnum")
    return edges.select("list_id", "parent_msgnum", "child_msgnum", "seq", "maybe_reply").join(child, ["list_id", "child_msgnum"])


def roots(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """Messages that reply to none."""
    return messages.join(edges.filter("parent_msgnum >= 0").select("list_id", F.col("child_msgnum").alias("msgnum")), ["list_id", "msgnum"], "left_anti")


def replies(messages: DataFrame, edges: DataFrame) -> DataFrame:
    return messages.join(edges.filter("parent_msgnum >= 0").select("list_id", F.col("child_msgnum").alias("msgnum")), ["list_id", "msgnum"], "left_semi")


def folder_edges(edges: DataFrame, folders: DataFrame) -> DataFrame:
    """Edges with both ends in one folder. folders: list_id, msgnum, folder."""
    a = folders.select("list_id", F.col("msgnum").alias("parent_msgnum"), "folder")
    b = folders.select("list_id", F.col("msgnum").alias("child_msgnum"), F.col("folder").alias("_folder"))
    return edges.join(a, ["list_id", "parent_msgnum"]).join(b, ["list_id", "child_msgnum"]).filter("folder = _folder").drop("_folder")


def _tour(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(list_id, at, next, n_enter, level): the steps of a walk round each tree. Node m is entered at
    2 m and left at 2 m + 1; next is the step that follows, null after a root is left."""
    child = edges.filter("parent_msgnum >= 0").select("list_id", F.col("parent_msgnum").cast("bigint").alias("p"), F.col("child_msgnum").cast("bigint").alias("c"), "seq")
    child = child.withColumn("_next", F.lead("c").over(W.partitionBy("list_id", "p").orderBy("seq", "c")))
    first = child.groupBy("list_id", F.col("p").alias("m")).agg(F.min_by("c", F.struct("seq", "c")).alias("_first"))
    nodes = messages.select("list_id", F.col("msgnum").cast("bigint").alias("m"))
    enter = nodes.join(first, ["list_id", "m"], "left").select(
        "list_id", (F.col("m") * 2).alias("at"), F.coalesce(F.col("_first") * 2, F.col("m") * 2 + 1).alias("next"), F.lit(1).cast("bigint").alias("n_enter"), F.lit(1).cast("bigint").alias("level"))
    after = child.select("list_id", F.col("c").alias("m"), F.coalesce(F.col("_next") * 2, F.col("p") * 2 + 1).alias("next"))
    leave = nodes.join(after, ["list_id", "m"], "left").select(
        "list_id", (F.col("m") * 2 + 1).alias("at"), "next", F.lit(0).cast("bigint").alias("n_enter"), F.lit(-1).cast("bigint").alias("level"))
    return enter.unionByName(leave)


def _walked(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """(list_id, root, msgnum, depth, ord, size) of all messages of trees that have a root, by list ranking."""
    # end: the last step reached so far; done where it is the end of the list
    active = written(_tour(messages, edges).withColumn("end", F.col("at")))
    done = written(active.filter("next IS NULL"))
    active, finished = active.filter("next IS NOT NULL"), done
    n = active.count()
    while n:
        every = active.unionByName(finished).select(
            "list_id", F.col("at").alias("next"), F.col("next").alias("_next"), F.col("n_enter").alias("_n"), F.col("level").alias("_level"), F.col("end").alias("_end"))
        stepped = written(active.join(every, ["list_id", "next"]).select(
            "list_id", "at", F.col("_next").alias("next"), (F.col("n_enter") + F.col("_n")).alias("n_enter"), (F.col("level") + F.col("_level")).alias("level"), F.col("_end").alias("end")))
        fresh, active = stepped.filter("next IS NULL"), stepped.filter("next IS NOT NULL")
        left = active.count()
        if left == n:
            break  # cycles
        finished, n = finished.unionByName(fresh), left
    # both steps of a message in one row: what is entered between them is its own tree
    entering = F.col("at") % 2 == 0
    both = finished.groupBy("list_id", F.shiftright("at", 1).alias("msgnum")).agg(
        F.max(F.when(entering, F.shiftright("end", 1))).alias("root"), F.max(F.when(entering, -F.col("level"))).cast("int").alias("depth"),
        F.max(F.when(entering, F.col("n_enter"))).alias("n_enter"), F.max(F.when(~entering, F.col("n_enter"))).alias("_after"))
    of_root = both.filter("root = msgnum").select("list_id", "root", F.col("n_enter").alias("_all"))
    return both.join(of_root, ["list_id", "root"]).select(
        "list_id", "root", "msgnum", "depth", (F.col("_all") - F.col("n_enter")).cast("int").alias("ord"), (F.col("n_enter") - F.col("_after")).alias("size"))


def thread_walk(spark: SparkSession, messages: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Pre-order walk of a forest (each child has one parent): list_id, root, msgnum, depth, ord,
    shown. ord counts within the thread; threads follow their root's (date, msgnum).

    By list ranking: a tour round each tree is a list of steps, whose sums to the end are taken by
    doubling. A chain of n messages takes log2(2 n) rounds of one join each, every round is written, and
    no tree is one task. shown is false where depth exceeds max_depth. Messages on a cycle have no
    root and aren't reached; thread_walk_general takes them.
    """
    kind = messages.schema["msgnum"].dataType
    return _walked(messages, edges).select("list_id", F.col("root").cast(kind).alias("root"), F.col("msgnum").cast(kind).alias("msgnum"), "depth", "ord", (F.col("depth") <= max_depth).alias("shown"))


def _walk_component(nodes: pd.DataFrame, edges: pd.DataFrame, max_depth: int) -> pd.DataFrame:
    children: dict[int, list[int]] = {}
    for p, c in edges.sort_values("seq")[["parent_msgnum", "child_msgnum"]].itertuples(index=False):
        children.setdefault(int(p), []).append(int(c))
    has_parent = set(edges["child_msgnum"][edges["parent_msgnum"] >= 0])
    order = [int(x) for x in nodes.sort_values(["date", "msgnum"])["msgnum"]]
    seen, out = set(), []
    # roots by date, then whatever no root reaches (cycles), the earliest first
    for start in [x for x in order if x not in has_parent] + order:
        stack, n = [(start, 0)], 0
        while stack:
            node, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((start, node, depth, n, depth <= max_depth))
            n += 1
            stack += [(c, depth + 1) for c in reversed(children.get(node, []))]
    result = pd.DataFrame(out, columns=["root", "msgnum", "depth", "ord", "shown"])
    result.insert(0, "list_id", nodes["list_id"].iloc[0] if len(nodes) else None)
    return result


def components(messages: DataFrame, edges: DataFrame) -> DataFrame:
    """list_id, msgnum, component: the least msgnum that edges connect, by label propagation with
    pointer jumping, until no label changes; written each round."""
    both = edges.select("list_id", F.col("parent_msgnum").alias("a"), F.col("child_msgnum").alias("b"))
    both = written(both.unionByName(both.select("list_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, changed = messages.select("list_id", "msgnum", F.col("msgnum").alias("component")), 1
    while changed:
        near = both.join(labels.withColumnRenamed("msgnum", "a"), ["list_id", "a"]).groupBy("list_id", F.col("b").alias("msgnum")).agg(F.min("component").alias("_near"))
        step = labels.withColumn("_old", F.col("component")).join(near, ["list_id", "msgnum"], "left").withColumn("component", F.least("component", F.coalesce("_near", "component"))).drop("_near")
        jump = step.select("list_id", F.col("msgnum").alias("component"), F.col("component").alias("_up"))
        labels = written(step.join(jump, ["list_id", "component"]).select("list_id", "msgnum", F.col("_up").alias("component"), "_old"))
        changed = labels.filter("component <> _old").count()
        labels = labels.drop("_old")
    return labels


#: Rounds after which threads that have a reply older than its parent, and may so have cycles, go to one task each.
ROUNDS = 32


def _settled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks of threads in which messages have several parents: (walk, left), left being the (list_id, component) that
    are not settled, because of cycles. nodes: list_id, msgnum, date, component; edges: their distinct real edges (list_id, p, c, seq).

    A walk visits a message by that edge of its parents which it comes to first. Each message takes one parent,
    the trees are walked in parallel, and then each message takes the parent whose edge that walk comes to first, until none changes:
    then the trees are those of the walk. Where a message takes its edge depends on its ancestors alone, so that without
    cycles every round settles one more message of several parents on each path. Since edges found first, those of headers, come
    first in a walk too, the first guess is mostly right."""
    home = nodes.select("list_id", F.col("msgnum").cast("bigint").alias("c"), "component")
    own = written(edges.join(home, ["list_id", "c"]))
    back = written(own.filter("p >= c").select("list_id", "component").distinct())
    dates = nodes.select("list_id", F.col("msgnum").cast("bigint").alias("root"), F.col("date").alias("_date"))
    choose = lambda df, *order: df.groupBy("list_id", "c").agg(F.min_by(F.struct("p", "seq"), F.struct(*order)).alias("x")).select("list_id", "c", "x.p", "x.seq")
    taken, left, k = written(choose(own, (F.col("p") >= F.col("c")).alias("_late"), F.col("seq"), F.col("p"))), None, 0
    while True:
        tree = taken.select("list_id", F.col("p").alias("parent_msgnum"), F.col("c").alias("child_msgnum"), "seq")
        walk = written(_walked(nodes, tree))
        missed = nodes.join(walk.select("list_id", "msgnum"), ["list_id", "msgnum"], "left_anti").select("list_id", "component").distinct()
        known = walk.select("list_id", F.col("msgnum").alias("p"), "root", "ord", "depth").join(dates, ["list_id", "root"])
        held = taken.select("list_id", "p", "c", "seq", F.lit(True).alias("_taken")).join(walk.select("list_id", F.col("msgnum").alias("c"), "size"), ["list_id", "c"])
        before = W.partitionBy("list_id", "p").orderBy("seq", "c").rowsBetween(W.unboundedPreceding, -1)
        placed = own.join(held, ["list_id", "p", "c", "seq"], "left").withColumn("_slot", F.coalesce(F.sum("size").over(before), F.lit(0))).join(known, ["list_id", "p"])
        # the edge is come to when the earlier children of its parent are done; of equal places the deeper one is first
        better = choose(placed, F.col("_date"), F.col("root"), (F.col("ord") + 1 + F.col("_slot")).alias("_at"), (-F.col("depth")).alias("_up"), F.col("seq"))
        step = written(better.join(taken.select("list_id", "c", F.col("p").alias("_p")), ["list_id", "c"]).withColumn("_moved", F.col("p") != F.col("_p")))
        moving, k = step.filter("_moved").join(home, ["list_id", "c"]).select("list_id", "component").distinct(), k + 1
        lost = missed.unionByName(moving.join(back, ["list_id", "component"], "left_semi")).distinct() if k >= ROUNDS else missed
        lost = written(lost)
        if not lost.isEmpty():  # they are left, the others go on
            left = lost if left is None else written(left.unionByName(lost))
            nodes = written(nodes.join(lost, ["list_id", "component"], "left_anti"))
            own = written(own.join(lost, ["list_id", "component"], "left_anti"))
            home = nodes.select("list_id", F.col("msgnum").cast("bigint").alias("c"), "component")
        taken = step.select("list_id", "c", "p", "seq").join(home.select("list_id", "c"), ["list_id", "c"], "left_semi")
        if step.filter("_moved").join(home.select("list_id", "c"), ["list_id", "c"], "left_semi").isEmpty():
            reached = walk.join(nodes.select("list_id", "msgnum"), ["list_id", "msgnum"], "left_semi")
            return reached, left if left is not None else nodes.select("list_id", "component").filter("false")
        taken = written(taken)


def thread_walk_general(messages: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """As thread_walk, also for cycles and for messages with several parents (each is visited once, by the edge that
    the walk comes to first).

    Connected threads in which each message has one parent and which have a root are trees and walked as
    such, however large; those with second parents by walks of trees that are mended until they are the one walk. Only threads
    with cycles that this doesn't settle, where a visit depends on all before it, are taken by one task each."""
    part = components(messages, edges)
    real = written(edges.filter("parent_msgnum >= 0").select("list_id", F.col("parent_msgnum").cast("bigint").alias("p"), F.col("child_msgnum").cast("bigint").alias("c"), "seq"))
    parents = real.groupBy("list_id", F.col("c").alias("msgnum")).agg(F.count(F.lit(1)).alias("_n"))
    counted = part.join(parents, ["list_id", "msgnum"], "left")
    odd = written(counted.groupBy("list_id", "component").agg(
        F.coalesce(F.max("_n"), F.lit(0)).alias("_most"), F.count_if(F.col("_n").isNull()).alias("_roots")).filter("_most > 1 OR _roots <> 1").select("list_id", "component"))
    is_odd = written(part.join(odd, ["list_id", "component"]).select("list_id", "msgnum", "component"))
    out = messages.join(is_odd.select("list_id", "msgnum"), ["list_id", "msgnum"], "left_anti")
    trees = thread_walk(messages.sparkSession, out, edges.join(is_odd.select("list_id", F.col("msgnum").alias("child_msgnum")), ["list_id", "child_msgnum"], "left_anti"), max_depth)
    if is_odd.isEmpty():
        return trees
    nodes = written(messages.select("list_id", "msgnum", "date").join(is_odd, ["list_id", "msgnum"]))
    several = real.groupBy("list_id", "p", "c").agg(F.min("seq").alias("seq"))
    walked, left = _settled(nodes, several)
    kind = messages.schema["msgnum"].dataType
    walked = walked.select("list_id", F.col("root").cast(kind).alias("root"), F.col("msgnum").cast(kind).alias("msgnum"), "depth", "ord", (F.col("depth") <= max_depth).alias("shown"))
    both = trees.unionByName(walked)
    if left.isEmpty():
        return both
    nodes = nodes.join(left, ["list_id", "component"], "left_semi")
    own = edges.join(nodes.select("list_id", F.col("msgnum").alias("child_msgnum"), "component"), ["list_id", "child_msgnum"]).select(
        *[F.col(c).alias(f"e_{c}") for c in ("list_id", "component")], "parent_msgnum", "child_msgnum", "seq")
    walk = lambda n, e: _walk_component(n, e, max_depth)
    rest = nodes.groupBy("list_id", "component").cogroup(own.groupBy("e_list_id", "e_component")).applyInPandas(
        walk, "list_id string, root int, msgnum int, depth int, ord int, shown boolean")
    return both.select(rest.columns).unionByName(rest)
