"""N-gram Jaccard join by a token-group matrix, exact.

1. Repeated tokens. A set that links with another shares at least `percent` of its shingles. Merged
   count-min sketches (sketch.py) give each sampled shingle (one in SAMPLE, by its hash, the same in
   every set) an estimate that is never too low; a set with more shingles of estimate 1 than a link
   may miss has no partner and sends nothing on.
2. Equal sets collapse to one, however many copies there are (combined before the shuffle).
3. Groups. Each set has a few minimum hashes, as keys; its pivot is that of its keys which most sets
   have, so that a family of near copies has one or few pivots. The sets of a pivot are cut into groups
   of bounded size. Each group links its own sets and stores the union of their tokens.
4. Token-group matrix. Tokens of the unions are counted: those of one pivot alone can't be shared with
   another, and a set with more of them than a link may miss has no partner outside its pivot and goes
   no further. The matrix's rows are the prefix tokens of the other sets (prefix filter: of the tokens that
   several pivots have, those that fewest have come first), its columns pivots: one entry for a token and
   a pivot, however many sets have it. A set is a query to the larger pivots that have SHARED of its own
   prefix tokens and whose sizes fit, and to the later groups of its own pivot; only then pivots are expanded to
   groups. The query's overlap with a group's stored union is bounded first, by its prefix and then by all of
   it, and only where it reaches the least overlap of a link the group is opened, that is, its members
   are read and compared.
5. Components of all links, and how many links each document has.

Every pair that may link is met once, within families too, and counts for both of its sets, weighted
by copies. Counts are summed in the task: what leaves it is at most one edge and one count for each
set. Pairs are listed only by `links`. Counting all links of a family of M distinct near copies compares
M * M / 2 sets; what is shuffled for it are M / (size of a group) times its tokens.

Defined results: a null or empty text, or one without words, has the empty set and links with
nothing; with fewer words than a shingle the whole sequence is the one shingle; rows repeated
with one doc_id are judged each by its own text; a null doc_id stays null, apart from all others;
any other 64-bit doc_id is legal; an empty table gives no rows; other columns are ignored. Rows
without a doc_id or a set have no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, partitions
from .components import connected
from .kernels import U64, Words, mix, shingle_sets
from .sketch import Chunk, Exchange, Layout, int_list

#: Sets in one group, queries that one task puts to a group, and tokens of either: about, at most.
BLOCK_SETS, QUERY_SETS, BLOCK_TOKENS = 1024, 1024, 1 << 20
SET_SCHEMA = "doc_id bigint, n bigint, set_hash binary, tokens binary, singles int, keys array<bigint>"
#: Minimum hashes of a set; one in 2^SAMPLE_BITS shingles is counted.
KEYS, SAMPLE_BITS = 8, 2
#: Tokens of their prefixes that two sets must share before the one is put to the other's groups.
SHARED = 8
GROUP = ("pivot", "block")
LINK_SCHEMA = "sid bigint, other bigint, n_links bigint"
#: Also, with sid null, each group's union and sizes.
BLOCK_SCHEMA = f"{LINK_SCHEMA}, pivot bigint, block int, n_min bigint, n_max bigint, tokens binary"
PREFIX_SCHEMA = "token bigint, set_hash binary, sid bigint, n bigint, pivot bigint, size bigint"
OPEN_SCHEMA = "g_pivot bigint, g_block int, part int, set_hash binary, sid bigint, n bigint"


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share: union >= n, so intersection >= percent/100 of n."""
    return -(-percent * n // 100)


def shared_least(percent: int) -> Column:
    """How many tokens the prefixes of a set (n) and of any set that it links with share at least: SHARED,
    or fewer where the least size of a partner asks for less."""
    return F.greatest(F.lit(1), F.least(F.lit(SHARED), F.floor(F.col("n") * (percent * percent) / 10_000)))


def prefix_length(n: int, percent: int) -> int:
    """A set lacks n - least_overlap of its tokens at most, so that of so many first ones as many are
    shared as shared_least says, in whatever order all sets have."""
    return min(n, n - least_overlap(n, percent) + SHARED)


def linked(common, n, m, percent: int):
    return 100 * common >= percent * (n + m - common)


def sampled(tokens: np.ndarray) -> np.ndarray:
    return tokens >> U64(64 - SAMPLE_BITS) == 0


def sets_of(chunk: Chunk, k: int) -> list[np.ndarray]:
    return shingle_sets(Words(chunk.data, chunk.offsets, fold=True), k)


def describe(batches: Iterator[pa.RecordBatch], k: int, percent: int, layout: Layout) -> Iterator[pa.RecordBatch]:
    """All documents with their set's size; sets that may have a partner with their tokens in
    ascending order of (not sampled, estimate, hash), the same order in every set."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk = Chunk.of(batch, row)
            sets = sets_of(chunk, k)
            sizes = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate(sets) if sets else np.empty(0, U64)
            some = sampled(every)
            estimates = np.full(len(every), np.iinfo(np.int64).max)
            estimates[some] = layout.estimates(every[some], int_list(batch, "cells", row), int_list(batch, "estimates", row))
            at, out = np.concatenate([[0], np.cumsum(sizes)]), []
            for i, own in enumerate(sets):
                estimate = estimates[at[i]: at[i + 1]]
                hashed = tokens = singles = keys = None
                alone = int(np.count_nonzero(estimate < 2))
                if len(own) and alone <= len(own) - least_overlap(len(own), percent):
                    tokens, singles = own[np.lexsort((own, estimate))].tobytes(), alone
                    keys = [int(mix(own + U64(j << 40)).min().astype(np.int64)) ^ j for j in range(1, KEYS + 1)]
                    hashed = b"".join(int(x).to_bytes(8, "little") for x in (np.bitwise_xor.reduce(mix(own)), own.sum(dtype=U64)))
                out.append((hashed, tokens, singles, keys))
            types = [pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [chunk.ids(), pa.array(sizes), *[pa.array(c, t) for c, t in zip(zip(*out), types)]], ["doc_id", "n", "set_hash", "tokens", "singles", "keys"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray], step: int = 2048) -> np.ndarray:
    """How many tokens each set of a shares with each set of b. Tokens that many sets have are counted
    by products of dense columns, the others by their pairs of owners."""
    na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    _, token = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.concatenate([np.repeat(np.arange(len(a)), na), np.repeat(np.arange(len(b)), nb)])
    split, size = int(na.sum()), int(token.max()) + 1 if len(token) else 0
    ca, cb = np.bincount(token[:split], minlength=size), np.bincount(token[split:], minlength=size)
    out = np.zeros((len(a), len(b)), np.float32)
    dense = np.flatnonzero(ca * cb * 32 >= len(a) * len(b))
    for lo in range(0, len(dense), step):
        place = np.full(size, -1)
        place[dense[lo: lo + step]] = np.arange(len(dense[lo: lo + step]))
        sides = []
        for own, rows in ((slice(0, split), len(a)), (slice(split, None), len(b))):
            x, at = np.zeros((rows, len(dense[lo: lo + step])), np.float32), place[token[own]]
            x[owner[own][at >= 0], at[at >= 0]] = 1
            sides.append(x)
        out += sides[0] @ sides[1].T
    few = (ca > 0) & (cb > 0)
    few[dense] = False
    # the sparse tokens of a, each with the run of its owners in b; some rows of a at a time
    order = np.argsort(token[split:], kind="stable")
    first, mine = np.concatenate([[0], np.cumsum(cb)]), np.flatnonzero(few[token[:split]])
    for part in np.array_split(mine, 1 + (int(cb[token[mine]].sum()) >> 20) + (out.size >> 20)):
        n = cb[token[part]]
        if not n.sum():
            continue
        at = np.repeat(first[token[part]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        lo, hi = owner[part[0]], owner[part[-1]] + 1
        pairs = np.repeat(owner[part] - lo, n) * len(b) + owner[split:][order[at]]
        out[lo:hi] += np.bincount(pairs, minlength=(hi - lo) * len(b)).reshape(hi - lo, len(b))
    return out


def links_between(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    n, m, common = np.array([len(x) for x in a]), np.array([len(x) for x in b]), overlaps(a, b)
    out = np.empty(common.shape, bool)
    for lo in range(0, len(a), 64):
        out[lo: lo + 64] = linked(common[lo: lo + 64].astype(np.int64), n[lo: lo + 64, None], m, percent)
    return out


def merged_labels(links: np.ndarray) -> np.ndarray:
    """A label for each column: columns that rows link with together have one label, the least column."""
    label = np.arange(links.shape[1])
    for row in links:
        own = np.unique(label[row])
        if len(own) > 1:
            label[np.isin(label, own)] = own[0]
    return label


def rows_of(edges: tuple[np.ndarray, np.ndarray], ids: np.ndarray, n_links: np.ndarray) -> dict[str, np.ndarray]:
    """Edges (sid, other) and counts (sid, sid, n_links) as columns of one table."""
    own = n_links > 0
    return {"sid": np.concatenate([edges[0], ids[own]]).astype(np.int64), "other": np.concatenate([edges[1], ids[own]]).astype(np.int64),
            "n_links": np.concatenate([np.zeros(len(edges[0]), np.int64), n_links[own]]).astype(np.int64)}


def pairs_of(links: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> dict[str, np.ndarray]:
    at, other = np.nonzero(links)
    return {"sid": rows[at].astype(np.int64), "other": columns[other].astype(np.int64), "n_links": np.zeros(len(at), np.int64)}


def tokens_in(table: pa.Table, name: str = "tokens") -> list[np.ndarray]:
    return [np.frombuffer(t, U64) for t in table[name].to_pylist()]


def ints_of(table: pa.Table, name: str) -> np.ndarray:
    """All integers of a column of lists."""
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(table) else np.empty(0, np.int64)


def ints_in(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def link_block(group: pa.Table, percent: int, listed: bool = False) -> pa.Table:
    """Links within one group: what leaves is at most one edge and one count for each set (or, listed,
    all its links once); and the group's union."""
    sets, ids, copies, n = tokens_in(group), ints_in(group, "sid"), ints_in(group, "copies"), ints_in(group, "n")
    none = np.empty(0, np.int64)
    if listed:
        found = pairs_of(np.triu(links_between(sets, sets, percent), 1), ids, ids)
    elif len(sets) == 1:
        found = rows_of((none, none), none, none)
    else:
        links = links_between(sets, sets, percent)
        label = merged_labels(links)
        own = label != np.arange(len(ids))
        found = rows_of((ids[own], ids[label[own]]), ids, links @ copies - copies)
    k = len(found["sid"])
    union = (sets[0] if len(sets) == 1 else np.concatenate(sets))
    last = {"pivot": group["pivot"][0].as_py(), "block": group["block"][0].as_py(), "n_min": int(n.min()), "n_max": int(n.max()), "tokens": np.unique(union).tobytes()}
    columns = [pa.array(np.append(found[c], 0), mask=np.arange(k + 1) == k) for c in ("sid", "other", "n_links")]
    columns += [pa.array([None] * k + [v], t) for v, t in zip(last.values(), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
    return pa.table(columns, names=[f.split()[0] for f in BLOCK_SCHEMA.split(", ")])


def open_groups(queries: pa.Table, unions: pa.Table) -> pa.Table:
    """Queries that share at least so many of the tokens given with the group's union."""
    out = queries.select(["g_pivot", "g_block", "part", "set_hash", "sid", "n"])
    if not len(queries) or not len(unions):
        return out.slice(0, 0)
    union, keep = tokens_in(unions, "g_tokens")[0], np.zeros(len(queries), bool)
    for i, (query, least) in enumerate(zip(tokens_in(queries), ints_in(queries, "least").tolist())):
        at = np.minimum(np.searchsorted(union, query), len(union) - 1)
        keep[i] = np.count_nonzero(union[at] == query) >= least
    return out.filter(pa.array(keep))


def link_queries(queries: pa.Table, members: pa.Table, percent: int, listed: bool = False) -> pa.Table:
    """Queries against one opened group: every link counts for both of its sets; at most one edge and one
    count leave for each set of either side (or, listed, all links)."""
    none = np.empty(0, np.int64)
    if not len(queries) or not len(members):
        return pa.table(rows_of((none, none), none, none))
    ids, copies, asks, weight = ints_in(members, "sid"), ints_in(members, "copies"), ints_in(queries, "sid"), ints_in(queries, "copies")
    links = links_between(tokens_in(queries), tokens_in(members), percent)
    if listed:
        return pa.table(pairs_of(links, asks, ids))
    label, some = merged_labels(links), links.any(1)
    own = label != np.arange(len(ids))
    edges = (np.concatenate([ids[own], asks[some]]), np.concatenate([ids[label[own]], ids[label[links[some].argmax(1)]]]))
    return pa.table(rows_of(edges, np.concatenate([ids, asks]), np.concatenate([weight @ links, links @ copies])))


def union_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, pivot, block) for the tokens of each group's union."""
    for batch in batches:
        for row in range(batch.num_rows):
            pivot, block, tokens = (batch.column(i)[row].as_py() for i in range(3))
            tokens = np.frombuffer(tokens, np.int64)
            for i in range(0, len(tokens), 1 << 17):
                part = tokens[i: i + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.full(len(part), pivot, np.int64)), pa.array(np.full(len(part), block, np.int32))], ["token", *GROUP])


def outward(sets: pa.Table, shared: pa.Table, percent: int) -> pa.Table:
    """Prefixes (PREFIX_SCHEMA) of those sets of a group that may link with sets of other pivots; shared: the
    group's tokens that other pivots have too, and how many have them. All others come first in the
    order and are left out."""
    names = [f.split()[0] for f in PREFIX_SCHEMA.split(", ")]
    found, seen = ints_of(shared, "shared").view(U64), ints_of(shared, "seen")
    order = np.argsort(found)
    found, seen, prefixes = found[order], seen[order], []
    for own in tokens_in(sets):
        at = np.minimum(np.searchsorted(found, own), len(found) - 1) if len(found) else np.empty(0, np.int64)
        at = at[found[at] == own] if len(found) else at
        if len(at) < least_overlap(len(own), percent):
            at = at[:0]
        # a place in found is a token's rank by hash
        prefixes.append(found[at[np.lexsort((at, seen[at]))][: max(0, prefix_length(len(own), percent) - (len(own) - len(at)))]].view(np.int64))
    take = pa.array(np.repeat(np.arange(len(sets)), [len(p) for p in prefixes]))
    tokens = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
    return pa.table([pa.array(tokens), *[sets[c].take(take) for c in names[1:]]], names=names)


def blocks_of(sets: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
    """Adds the part of its key in which each row (sid, n) is, and size, the rows of the key; a part has about
    `most` rows and BLOCK_TOKENS tokens at most. Counts combine before their shuffle, and the join back
    may be split, so that a key with a third of the sets is no hot task."""
    rows = F.count(F.lit(1))
    n = sets.groupBy(*keys).agg(rows.alias("size"), F.greatest(F.ceil(rows / most), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("_parts"))
    return sets.join(n, keys).withColumn(name, F.pmod(F.xxhash64("sid"), F.col("_parts")).cast("int")).drop("_parts")


def grouped(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """sets with pivot, the key of each that most sets have, size, the sets of the pivot, and block. Ids
    alone are dealt until then; the sets, bucketed by set_hash, meet them without a shuffle."""
    keyed = sets.select("set_hash", "sid", "n", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("_c"))
    pivots = keyed.join(counts, "key").groupBy("set_hash", "sid", "n").agg(F.max_by("key", F.struct("_c", "key")).alias("pivot"))
    own = blocks_of(scratch.save(pivots, "pivots"), ["pivot"], BLOCK_SETS, "block").drop("n", "sid")
    # bucketed again, so that whatever asks for a set's tokens by its hash doesn't move those of all sets
    return scratch.bucketed(sets.drop("keys").join(own.hint("merge"), "set_hash"), "blocks", partitions(scratch.spark), "set_hash")


def first_links(blocks: DataFrame, percent: int, listed: bool) -> DataFrame:
    """Links within each group, and its union."""
    own = blocks.select(*GROUP, "sid", "n", "tokens", "copies")
    return own.groupBy(*GROUP).applyInArrow(lambda t: link_block(t, percent, listed), BLOCK_SCHEMA)


def renamed(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df, those named with g_ before them."""
    return [F.col(c).alias(f"g_{c}") if c in names else F.col(c) for c in df.columns]


def fits(percent: int) -> Column:
    """Whether some size of the one side can link with some size of the other."""
    return (F.col("g_n_max") * 100 >= F.col("n_min") * percent) & (F.col("g_n_min") * percent <= F.col("n_max") * 100)


def outward_prefixes(own: DataFrame, unions: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """PREFIX_SCHEMA, of sets that may link with sets of other pivots.

    A token is counted by the pivots whose first group has it, which only orders tokens; that more
    than one pivot has it is exact. Counts combine before their shuffle; what they are joined to may be split.
    """
    entries = unions.select(*GROUP, "tokens").mapInArrow(union_tokens, "token bigint, pivot bigint, block int")
    counted = entries.groupBy("token").agg(F.count_if(F.col("block") == 0).alias("seen"), F.min("pivot").alias("_lo"), F.max("pivot").alias("_hi"))
    counted = scratch.save(counted.filter("_lo < _hi").select("token", "seen"), "counted")
    lists = entries.join(counted, "token").groupBy(*GROUP).agg(F.collect_list("token").alias("shared"), F.collect_list("seen").alias("seen"))
    # a group whose sets all are larger than its shared tokens allow sends nothing on
    lists = lists.join(unions.select(*GROUP, "n_min"), list(GROUP)).filter(F.size("shared") * 100 >= F.col("n_min") * percent)
    lists = scratch.save(lists.drop("n_min"), "shared")
    ids = own.select("set_hash", "sid", *GROUP).join(lists.select(*GROUP), list(GROUP)).select("set_hash")
    sets = own.select("set_hash", "sid", "n", "size", "tokens", *GROUP).hint("merge").join(ids, "set_hash")
    listed = scratch.load(lists, "shared")
    return scratch.save(sets.groupBy(*GROUP).cogroup(listed.groupBy(*GROUP)).applyInArrow(lambda s, t: outward(s, t, percent), PREFIX_SCHEMA), "prefixes")


def met_groups(own: DataFrame, unions: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(set_hash, sid, n, g_pivot, g_block): the groups that each set is put to, each pair of sets at most once.

    own: set_hash, sid, n, tokens, pivot, size and block; unions: pivot, block, n_min, n_max, tokens. Sets meet pivots by
    prefix tokens: what they are joined to has one entry for a token and a pivot, however many sets have it.
    Pivots are expanded to the groups of the larger one only after that."""
    spread = outward_prefixes(own, unions, scratch, percent)
    matrix = scratch.save(spread.groupBy("token", "pivot", "size").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max")), "matrix")
    other = matrix.select(*renamed(matrix, "pivot", "size", "n_min", "n_max"))
    once = F.struct("size", "pivot") < F.struct("g_size", "g_pivot")
    asks = spread.withColumns({"n_min": F.col("n"), "n_max": F.col("n")})
    shared = asks.join(other, "token").filter(once & fits(percent)).groupBy("set_hash", "sid", "n", "g_pivot").agg(F.count(F.lit(1)).alias("_shared"))
    shared = scratch.save(shared.filter(F.col("_shared") >= shared_least(percent)).drop("_shared"), "pairs")
    groups = unions.select("pivot", "block", "n_min", "n_max")
    groups = groups.select(*renamed(groups, *groups.columns))
    sets = own.select("set_hash", "sid", "n", "pivot", "block")
    apart = shared.join(groups, "g_pivot")
    family = sets.withColumnRenamed("pivot", "g_pivot").join(groups, "g_pivot").filter("block < g_block").drop("block")
    both = apart.unionByName(family)
    return both.withColumns({"n_min": F.col("n"), "n_max": F.col("n")}).filter(fits(percent)).select("set_hash", "sid", "n", "g_pivot", "g_block")


def group_links(own: DataFrame, unions: DataFrame, scratch: Scratch, percent: int, listed: bool) -> DataFrame:
    """The token-group matrix: links of queries with groups.

    own: sid, n, tokens, singles, copies, and pivot and block, which name a set's group; unions: a row
    a group with its sizes and its union.
    """
    g_group, key = ["g_pivot", "g_block"], ["g_pivot", "g_block", "part"]
    met = scratch.save(met_groups(own, unions, scratch, percent), "met")
    ids = scratch.save(blocks_of(met, g_group, QUERY_SETS, "part").drop("size"), "queries")
    stored = unions.select(*renamed(unions, *GROUP, "tokens")).select(*g_group, "g_tokens")
    # first the prefix of a query, a fifth of its tokens or less, then all of it for what is left
    start, size = F.col("singles"), F.least(F.col("n"), F.col("n") - F.ceil(F.col("n") * percent / 100) + SHARED) - F.col("singles")
    prefix = F.substring(F.col("tokens"), start * 8 + 1, (F.greatest(size, F.lit(0)) * 8).cast("int"))

    def with_tokens(rows: DataFrame, *columns: Column | str) -> DataFrame:
        """rows with columns of their sets, which stay where they are."""
        return rows.join(scratch.spark.table(f"blocks_{scratch.tag}").select("set_hash", *columns).hint("merge"), "set_hash")

    def bounded(asked: DataFrame, name: str, tokens: Column, least: Column, to: str) -> DataFrame:
        """The queries that share so many of the tokens with the group's union."""
        asks = with_tokens(asked, tokens.alias("tokens")).select(*key, "set_hash", "sid", "n", least.alias("least"), "tokens")
        # read anew, so that the two sides of a cogroup have columns of their own
        unions_of = stored.join(scratch.load(asked, name).select(*key).distinct(), g_group)
        return scratch.save(asks.groupBy(*key).cogroup(unions_of.groupBy(*key)).applyInArrow(open_groups, OPEN_SCHEMA), to)

    hinted = bounded(ids, "queries", prefix, shared_least(percent), "hinted")
    opened = bounded(hinted, "hinted", F.col("tokens"), F.ceil(F.col("n") * percent / 100), "opened")
    groups = scratch.load(opened, "opened").select(*key).distinct()
    member = scratch.spark.table(f"blocks_{scratch.tag}").select("set_hash", "sid", *[F.col(c).alias(f"g_{c}") for c in GROUP])
    members = with_tokens(member.join(groups, g_group), "tokens", "copies")
    queries = with_tokens(opened.select("set_hash", "sid", *key), "tokens", "copies")
    return queries.groupBy(*key).cogroup(members.groupBy(*key)).applyInArrow(lambda q, m: link_queries(q, m, percent, listed), LINK_SCHEMA)


def links_of(sets: DataFrame, scratch: Scratch, percent: int, listed: bool = False, counts: dict[str, int] | None = None) -> DataFrame:
    """sets: sid, n, tokens, singles, keys, copies of distinct sets, the scratch table `distinct`, which goes. Edges and counts of all links
    (LINK_SCHEMA), or, listed, every link once. Tables with tokens go as soon as nothing reads them."""
    blocks = grouped(sets, scratch)
    scratch.drop("distinct")
    both = scratch.save(first_links(blocks, percent, listed), "near")
    near, unions = both.filter("sid IS NOT NULL").select("sid", "other", "n_links"), both.filter("sid IS NULL").select(*GROUP, "n_min", "n_max", "tokens")
    far = group_links(blocks, unions, scratch, percent, listed)
    found = scratch.save(near.unionByName(far), "found")
    if counts is not None:
        counts.update(report(scratch))
    scratch.drop("near", "blocks", "pivots", "counted", "shared", "prefixes", "matrix", "pairs", "met", "queries", "hinted", "opened")
    return found


def report(scratch: Scratch) -> dict[str, int]:
    """Of a join: distinct sets, prefix tokens of those that may link with other pivots, entries of the matrix
    (token, pivot), pairs of a set and a pivot that share enough of them, queries put to the union of a group, those whose prefix shares enough with it, and those that opened the group."""
    tables = {"distinct": "blocks"} | {n: n for n in ("prefixes", "matrix", "pairs", "queries", "hinted", "opened")}
    return {n: scratch.spark.read.schema("sid bigint").parquet(scratch.path(t)).count() for n, t in tables.items()}


def distinct_sets(spark: SparkSession, docs: DataFrame, k: int, percent: int, depth: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """All documents (doc_id, n, set_hash), and the distinct sets that may have a partner with their copies."""
    ex = Exchange(spark, docs, "jaccard")
    scratch = ex.scratch

    def tokens(chunk: Chunk) -> np.ndarray:
        sets = sets_of(chunk, k)
        every = np.concatenate(sets) if sets else np.empty(0, U64)
        return every[sampled(every)]

    counts, layout = ex.estimate(tokens, depth, 2.0 ** -SAMPLE_BITS)
    described = scratch.save(ex.joined(counts).mapInArrow(lambda b: describe(b, k, percent, layout), SET_SCHEMA), "sets")
    scratch.drop("chunks", "counts")
    slim = scratch.save(described.select("doc_id", "n", "set_hash"), "documents")
    may = described.filter("tokens IS NOT NULL AND doc_id IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("n", "tokens", "singles", "keys")]
    distinct = may.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), *first)
    # numbered as written: two sets may share a doc_id
    numbered = distinct.withColumn("sid", F.monotonically_increasing_id())
    distinct = scratch.bucketed(numbered, "distinct", partitions(spark), "set_hash")
    scratch.drop("sets")
    return slim, distinct, scratch


def links(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, depth: int = 1) -> DataFrame:
    """(rep, other): every link between distinct sets once, each named by its least doc_id; copies
    of one set, which all link with each other, aren't listed."""
    _, distinct, scratch = distinct_sets(spark, docs, k, percent, depth)
    names = scratch.save(distinct.select("sid", "rep"), "names")
    found = links_of(distinct.drop("rep"), scratch, percent, True)
    return found.join(names, "sid").join(names.select(F.col("sid").alias("other"), F.col("rep").alias("_rep")), "other").select("rep", F.col("_rep").alias("other"))


def join(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, depth: int = 1, counts: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links of a Jaccard similarity
    of percent/100 or more between sets of k-word shingles) and n_links: how many other rows with a
    doc_id this one links with, rows of an equal set included. counts, if given, gets the report."""
    described, distinct, scratch = distinct_sets(spark, docs, k, percent, depth)
    names = scratch.save(distinct.select("set_hash", "sid", "rep", "copies"), "names")
    found = links_of(distinct.drop("rep"), scratch, percent, counts=counts)
    labels = connected(scratch, found.filter("sid <> other").select(F.col("sid").alias("a"), F.col("other").alias("b")), "links").withColumnRenamed("node", "sid")
    far = found.groupBy("sid").agg(F.sum("n_links").alias("n_far"))
    reps = scratch.save(names.join(labels, "sid", "left").join(far, "sid", "left").select(
        "set_hash", "rep", F.coalesce("component", "sid").alias("component"), (F.coalesce("n_far", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labelled")
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    reps = scratch.save(reps.join(least, "component").select("set_hash", "component_id", "n_links"), "reps")
    own = described.select("doc_id", F.col("n").alias("n_shingles"), "set_hash")
    has_id = F.col("doc_id").isNotNull()
    return own.join(reps, "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(has_id, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.when(has_id, F.col("n_links")), F.lit(0).cast("bigint")).alias("n_links"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, documents(spark, sf_dir), k=4, percent=85)


#: Links between distinct sets, then the least doc_id that each reaches, and links weighted by copies.
ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS grams FROM t),
d AS (SELECT grams, min(doc_id) AS rep, count(*) AS copies FROM g WHERE len(grams) > 0 GROUP BY grams),
p AS (SELECT rep, len(grams) AS n, unnest(grams) AS gram FROM d),
l AS (SELECT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.gram = b.gram AND a.rep <> b.rep
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT rep, rep FROM d UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a),
f AS (SELECT l.a AS rep, sum(d.copies) AS n FROM l JOIN d ON d.rep = l.b GROUP BY l.a)
SELECT g.doc_id, CAST(len(g.grams) AS BIGINT) AS n_shingles, coalesce(c.component_id, g.doc_id) AS component_id, CAST(coalesce(d.copies - 1, 0) + coalesce(f.n, 0) AS BIGINT) AS n_links
FROM g LEFT JOIN d ON d.grams = g.grams LEFT JOIN c ON c.rep = d.rep LEFT JOIN f ON f.rep = d.rep
"""
