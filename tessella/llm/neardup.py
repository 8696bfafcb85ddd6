"""Near-duplicate documents by an LSH forest of MinHash signatures.

Texts with the same set of shingles are one node.  A signature is ``TREES`` rows of ``DEPTH``
minima; each row puts the nodes into one sorted order, a tree of the forest.  Nodes that share
a row's first ``SHALLOW`` minima are a region, and ``1 - (1 - 0.8**SHALLOW)**TREES`` of the pairs
at the threshold meet in one: all but three in a million.

Depth adapts by region.  A region of up to ``REGION`` nodes is one task: its members stand in
their tree's order, neighbours with the longest common prefixes are compared first, and a level
up only what different branches hold and no component has joined yet.  A larger region is taken
deeper, prefix by prefix, until its parts fit.  What that leaves out is made up for exactly: each
member outside its region's largest component then meets all members of the region, slice by
slice.  No region and no list of partners has a cap.

Signatures only propose.  Nodes that proposals connect are brought together with their whole
sets, and links are confirmed on those; a pair is skipped only if its signatures are far apart or
if the two already belong to one component.  Large groups go slice by slice around one hub, and
what the hub's component leaves out meets all of the group in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_text, prepare, release, trim
from .hashing import U, mix, shingles_of

TREES, DEPTH, SHALLOW = 24, 8, 4
LENGTH = TREES * DEPTH
#: Share of equal minima below which two signatures can't belong to a pair at 0.8 (six deviations).
PROPOSE = 0.62
#: Members of a region, or of a proposed group, that one task compares with as many others; bytes of
#: text that it takes of a group.
REGION, GROUP, GROUP_BYTES = 1024, 1024, 8 << 20
#: Hashes of shingles looked up at a time.
SPAN = 1 << 20
_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 2**63, LENGTH, dtype=np.int64).astype(U) * U(2) + U(1)
_B = _RNG.integers(0, 2**63, LENGTH, dtype=np.int64).astype(U)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value of each of ``LENGTH`` hash functions over a set."""
    low = np.full(LENGTH, ~U(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 512):
            np.minimum(low, (shingles[at : at + 512, None] * _A + _B).min(0), out=low)
    return (mix(low) >> U(48)).astype(">u2")


def nodes_of(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, node, sig, text_key) of each row; node and sig are null for empty sets.

    ``text_key`` is Spark's xxhash64 of the text, by which a node's text is found again.
    """

    def work(_, texts):
        sets = shingles_of([(t or "").encode() for t in texts], words)
        return {
            "n_shingles": [len(s) for s in sets],
            "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "sig": [signature(s).tobytes() if len(s) else None for s in sets],
            "text_key": np.array([xxhash.xxh64_intdigest((t or "").encode(), 42) for t in texts], U).view(np.int64),
        }

    return map_text(docs, work, "doc_id long, n_shingles long, node binary, sig binary, text_key long", id_col, text_col)


def merge(root: np.ndarray, branch: np.ndarray, similar: Callable[[int, np.ndarray], np.ndarray], asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Join the components ``root`` of members of different branches; returns the pairs that joined them.

    ``similar(i, others)`` is asked once for each pair that no component holds yet; with ``asks``
    only for pairs of which one member asks.
    """
    made: list[tuple[int, int]] = []
    done = np.zeros(len(root), bool)
    for i in range(len(root)) if asks is None else np.flatnonzero(asks).tolist():
        done[i] = True
        open_ = root != root[i]
        others = np.flatnonzero(open_ & (branch != branch[i]) & ~done)
        if not len(others):
            if not open_.any():
                break
            continue
        hit = others[similar(i, others)]
        if len(hit):
            joined, at = np.unique(root[hit], return_index=True)
            made += [(i, int(j)) for j in hit[at]]
            root[np.isin(root, joined)] = root[i]
    return made


def ascend(common: np.ndarray, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that join the members of a sorted region, deepest common prefixes first.

    ``common[i]``: length of the prefix that members i - 1 and i share.
    """
    n = len(common)
    everyone = np.arange(1, n)
    if similar(0, everyone).all():
        return [(0, int(j)) for j in everyone]
    root, made = np.arange(n), []
    for depth in np.unique(common[1:])[::-1]:
        edge = np.append(np.flatnonzero(np.append(True, common[1:] < depth)), n)
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            branch = np.cumsum(np.append(False, common[lo + 1 : hi] == depth))
            if branch[-1]:
                pairs = merge(root[lo:hi], branch, lambda i, others, lo=lo: similar(lo + i, lo + others))
                made += [(lo + i, lo + j) for i, j in pairs]
    return made


def streamed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from rows sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        end = tuple(b.column(k)[b.num_rows - 1].as_py() for k in range(keys))
        at = b.num_rows
        while at and tuple(b.column(k)[at - 1].as_py() for k in range(keys)) == end:
            at -= 1
        if at or last is not None and end != last:
            held.append(b.slice(0, at))
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(at))
        last = end
    if held:
        yield pa.Table.from_batches(held)


def borders(table: pa.Table, keys: int) -> np.ndarray:
    """Where groups of equal first columns start, and the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        c = table.column(k).combine_chunks()
        new[1:] |= np.asarray(pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)))
    return np.append(np.flatnonzero(new), table.num_rows)


EDGE = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def edge_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    both = [(a, b) if a < b else (b, a) for a, b in pairs if a != b]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in both], pa.binary()) for k in (0, 1)], schema=EDGE)


def afresh(c: str) -> Column:
    """A node or prefix by which Spark doesn't know its rows to be dealt out.

    A join on it has an exchange of its own, which adaptive execution can split where a key is hot.
    An expression that isn't deterministic leaves no constraints for the optimizer to carry on.
    """
    return F.when(F.spark_partition_id() >= 0, F.col(c)).alias(c)


def signatures(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["sig"].to_pylist()), ">u2").reshape(-1, LENGTH)


def near(sig: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    """Are the signatures of a member and of others close enough for a pair at the threshold?"""
    return lambda i, others: (sig[others] == sig[i]).mean(1) >= PROPOSE


def link(sig: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Are the full sets of a member and of others similar?"""
    part, whole = threshold
    close, n = near(sig), np.array([len(s) for s in sets])

    def similar(i: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        at = np.flatnonzero(close(i, others))
        for some in np.split(at, np.flatnonzero(np.diff(np.cumsum(n[others[at]]) // SPAN)) + 1) if len(at) else []:
            js = others[some]
            flat = np.concatenate([sets[j] for j in js])
            place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            same = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(n[js]) - n[js])
            out[some] = whole * same >= part * (n[js] + n[i] - same)
        return out

    return similar


def in_groups(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """Edges from ``work(table, borders)``, which gives pairs of row numbers of tables of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in streamed(batches, len(keys)):
            node = table["node"].to_pylist()
            yield edge_batch([(node[i], node[j]) for i, j in work(table, borders(table, len(keys)))])
        trim()

    first = rows.select(*keys, *[c for c in rows.columns if c not in keys])
    return first.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, "u binary, v binary")


def cells(members: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the cells (keys, a, b) in which what a group's largest component leaves out meets the group.

    ``members``: (keys, node, comp, w, ...); w is a member's share of what one task takes.  Slice a of
    those outside (``asks``) and slice b of all members make a cell.
    """
    of = members.groupBy(*keys, "comp").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    whole = of.groupBy(*keys).agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max_by("w", F.struct("n", "comp")).alias("in"), F.sum("w").alias("all"), F.count("*").alias("k"))
    sized = whole.where("k > 1").select(
        *map(afresh, keys), "main", F.ceil(F.col("all") - F.col("in") + 1e-9).cast("int").alias("_a"), F.ceil("all").cast("int").alias("_b")
    )
    rows = members.join(sized, keys)
    h = F.xxhash64("node")
    kept = [*keys, *[c for c in members.columns if c not in (*keys, "w")]]
    out = rows.where("comp <> main").select(*kept, F.pmod(h, F.col("_a")).alias("a"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("b"), F.lit(True).alias("asks"))
    return out.unionByName(rows.select(*kept, F.explode(F.sequence(F.lit(0), F.col("_a") - 1)).alias("a"), F.pmod(h, F.col("_b")).alias("b"), F.lit(False).alias("asks")))


def asked(table: pa.Table, similar: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that join components of a cell."""
    _, root = np.unique(np.array(table["comp"].to_pylist(), "S32"), return_inverse=True)
    return merge(root, np.arange(len(root)), similar, table["asks"].to_numpy())


def each_group(edge: np.ndarray, pairs_of: Callable[[int, int], list[tuple[int, int]]]) -> list[tuple[int, int]]:
    return [(lo + i, lo + j) for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if hi - lo > 1 for i, j in pairs_of(lo, hi)]


def settled(first: DataFrame, crowded: DataFrame | None, keys: list[str], meet: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components (node, root) of the edges ``first`` and of those that ``meet`` finds in the cells of ``crowded``."""
    known = components(first)
    if crowded is None:
        return known
    of = crowded.join(known.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    more = cut(meet(cells(of, keys)))
    if not any_row(more):
        return known
    return components(known.select(F.least("node", "root").alias("u"), F.greatest("node", "root").alias("v")).union(more))


def any_row(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def propose(nodes: DataFrame) -> DataFrame:
    """Groups (node, root) of the nodes that close signatures connect."""
    rows = nodes.select("node", "sig")
    own = F.substring(F.col("sig"), F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH))
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring("sig", 2 * t * DEPTH + 1, 2 * SHALLOW).alias("region")) for t in range(TREES)]))
    placed = rows.select("node", trees.alias("r")).select("r.tree", "r.region", "node")

    def sized(members: DataFrame, least: int = 2) -> DataFrame:
        return cut(members.groupBy("tree", "region").agg(F.count("*").alias("n")).where(F.col("n") >= least))

    sizes, slice_ = sized(placed), F.lit(0).alias("slice")
    fits, large = f"n <= {REGION}", f"n > {REGION}"
    dealt = [placed.join(sizes.where(fits), ["tree", "region"]).select("tree", "region", slice_, "node")]
    crowded = None
    if any_row(sizes.where(large)):
        crowded = cut(placed.join(sizes.where(large).drop("n"), ["tree", "region"]).join(rows, "node").select("tree", "region", "node", own.alias("key")))
        levels = F.explode(F.array(*[F.substring("key", 1, 2 * d) for d in range(SHALLOW + 1, DEPTH + 1)]))
        deeper = crowded.select("tree", "node", levels.alias("region"))
        # of each node and tree the first depth that fits; shorter prefixes have fewer bytes
        ok = deeper.join(sized(deeper, 1), ["tree", "region"]).where(f"n <= {REGION} or octet_length(region) = {2 * DEPTH}")
        best = ok.groupBy("tree", "node").agg(F.min(F.struct(F.octet_length("region").alias("d"), "region", "n")).alias("b"))
        # equal to the end: parts of the region's nodes
        part = F.when(F.col("b.n") > REGION, F.pmod(F.xxhash64("node"), F.ceil(F.col("b.n") / REGION))).otherwise(0)
        dealt.append(best.where("b.n > 1").select("tree", "b.region", part.cast("int").alias("slice"), "node"))
    signed = reduce(DataFrame.unionByName, dealt).join(rows, "node").select("tree", "region", "slice", own.alias("key"), "node", "sig")

    def up(table: pa.Table, edge: np.ndarray) -> list[tuple[int, int]]:
        sig = signatures(table)
        key = np.frombuffer(b"".join(table["key"].to_pylist()), ">u2").reshape(-1, DEPTH)
        common = np.append(0, np.cumprod(key[1:] == key[:-1], axis=1).sum(1))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        pairs = [(i, i + 1) for i in two[(sig[two] == sig[two + 1]).mean(1) >= PROPOSE].tolist()]
        for k in np.flatnonzero(size > 2):
            lo, hi = int(edge[k]), int(edge[k + 1])
            pairs += [(lo + i, lo + j) for i, j in ascend(common[lo:hi], near(sig[lo:hi]))]
        return pairs

    first = in_groups(signed, ["tree", "region", "slice"], ["key"], up)

    def meet(rest: DataFrame) -> DataFrame:
        def work(table: pa.Table, edge: np.ndarray) -> list[tuple[int, int]]:
            sig = signatures(table)
            return each_group(edge, lambda lo, hi: asked(table.slice(lo, hi - lo), near(sig[lo:hi])))

        return in_groups(rest.join(rows, "node"), ["tree", "region", "a", "b"], [], work)

    weighed = None if crowded is None else crowded.select("tree", "region", "node", F.lit(1 / REGION).alias("w"))
    return settled(first, weighed, ["tree", "region"], meet)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u < v); root is the smallest node that it reaches.

    Alternates large and small stars until the edges stand still.  Minima are aggregated before
    they are joined, and the joins deal their sides out anew, so a hub is a sum and a join that
    Spark can split.
    """
    edges = cut(edges.where("u <> v").distinct())
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(afresh("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m")).select(afresh("v"), "m")
        small = large.join(low, "v").select(F.explode(F.array(F.struct("m", F.col("v").alias("w")), F.struct("m", F.col("u").alias("w")))).alias("e"))
        edges = cut(small.select(F.col("e.m").alias("u"), F.col("e.w").alias("v")).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(edges.sparkSession)
        if now == state:
            break
        state = now
    tails = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    heads = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return tails.union(heads)


def confirm(grouped: DataFrame, words: int, threshold: tuple[int, int]) -> DataFrame:
    """Components (node, root) of the links between the full sets of each proposed group.

    ``grouped``: (grp, node, sig, text).  A group that is more than one task takes goes in slices,
    each with the group's hub; the slices' rests then meet the whole group.
    """
    weight = F.greatest(F.lit(1 / GROUP), F.octet_length("text") / GROUP_BYTES)
    rows = grouped.select("grp", "node", "sig", "text", weight.alias("w"))
    sizes = cut(rows.groupBy("grp").agg(F.ceil(F.sum("w")).cast("int").alias("slices"), F.min("node").alias("hub")))
    mine = F.pmod(F.xxhash64("node"), F.col("slices"))
    sized = rows.join(sizes, "grp")
    dealt = sized.select("grp", mine.alias("slice"), "node", "sig", "text")
    crowded = None
    if any_row(sizes.where("slices > 1")):
        large = sized.where("slices > 1")
        hubs = large.where("node = hub").select("grp", F.explode(F.filter(F.sequence(F.lit(0), F.col("slices") - 1), lambda x: x != mine)).alias("slice"), "node", "sig", "text")
        dealt, crowded = dealt.unionByName(hubs.withColumn("slice", F.col("slice").cast("bigint"))), large.select("grp", "node", "sig", "text", "w")

    def sets_of(table: pa.Table, lo: int, hi: int) -> list[np.ndarray]:
        return shingles_of([t.encode() for t in table["text"].slice(lo, hi - lo).to_pylist()], words)

    def whole(table: pa.Table, edge: np.ndarray) -> list[tuple[int, int]]:
        sig = signatures(table)
        return each_group(edge, lambda lo, hi: merge(np.arange(hi - lo), np.arange(hi - lo), link(sig[lo:hi], sets_of(table, lo, hi), threshold)))

    def rest(table: pa.Table, edge: np.ndarray) -> list[tuple[int, int]]:
        sig = signatures(table)
        return each_group(edge, lambda lo, hi: asked(table.slice(lo, hi - lo), link(sig[lo:hi], sets_of(table, lo, hi), threshold)))

    first = in_groups(dealt, ["grp", "slice"], ["sig"], whole)
    return settled(first, crowded, ["grp"], lambda left: in_groups(left, ["grp", "a", "b"], [], rest))


def classes(
    docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Two rows are linked where intersection / union of their ``words``-word shingle sets is
    ``threshold`` (a fraction of at least 0.8) or more; ``component_id`` is the smallest id that
    links reach.  A text of fewer words is one shingle; null texts and texts without words have
    none, link with nothing and are kept.  ``kept``: the id is the component's.  Each row is
    judged by its own text: rows that repeat an id with other texts may be in different classes.
    A row without an id is in the class of its links, null where they have no id either, and kept
    only there.  An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    if 100 * threshold[0] < 80 * threshold[1]:
        raise ValueError("signatures find pairs of similarity 0.8 or more only")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = cut(nodes_of(rows, words, "doc_id", "text"))
    nodes = cut(
        made.where("node is not null")
        .groupBy("node")
        .agg(F.first("sig").alias("sig"), F.min("doc_id").alias("label"), F.min(F.struct("doc_id", "text_key")).alias("source"))
    )
    wanted = propose(nodes).join(nodes, "node").select(F.col("root").alias("grp"), "node", "sig", "source")
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    same = keyed.doc_id.eqNullSafe(wanted.source.doc_id) & (keyed.text_key == wanted.source.text_key)
    grouped = keyed.join(wanted, same).select("grp", "node", "sig", "text").groupBy("grp", "node").agg(
        F.first("sig").alias("sig"), F.first("text").alias("text")
    )
    linked = confirm(cut(grouped), words, threshold).join(nodes.select("node", "label"), "node")
    least = linked.groupBy("root").agg(F.min("label").alias("least")).select(afresh("root"), "least")
    of = linked.join(least, "root").select("node", "least")
    # one mapping, one join: its large side may hold very many rows of one node
    mapping = nodes.select("node", "label").join(of, "node", "left").select("node", F.coalesce("least", "label").alias("least"))
    out = made.select("doc_id", "n_shingles", "node").join(cut(mapping), "node", "left")
    component = F.coalesce("least", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.col("node").isNull() | F.col("least").isNull()).alias("kept"),
    )


def filter_documents(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of ``docs``, with all its columns: that of the smallest id.

    Rows are told apart by their place, so repeated rows, ids that several rows bear and rows
    without an id count as documents of their own: of a class exactly one row stays, one without an
    id only where no member has one.  Null texts and texts without words stay.  An empty table
    stays empty.  ``docs`` is read twice and has to hold the same rows in the same partitions each
    time, as a written or checkpointed table does.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    placed = docs.withColumn(name, F.monotonically_increasing_id())
    of = classes(placed, words, threshold, name, text_col).select(F.col("doc_id").alias(name), "component_id")
    best = of.join(placed.select(name, F.col(id_col).cast("long").alias("_i")), name)
    first = best.groupBy("component_id").agg(F.min(F.struct(F.col("_i").isNull().alias("n"), "_i", F.col(name).alias("r"))).alias("b"))
    return placed.join(first.select(F.col("b.r").alias(name)), name, "left_semi").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""
