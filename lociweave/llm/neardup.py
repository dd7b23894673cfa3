"""Near-duplicate documents through an inverted join over minhash signature coordinates.

Method: every distinct shingle set posts itself under each (coordinate, value) pair of its signature. A pair of sets
whose Jaccard similarity reaches the threshold agrees on at least ``match_threshold`` of the coordinates but for odds
below about one in a million, so it must meet in the ``coordinates - match_threshold + 1`` rarest postings of either
set: only that prefix is joined. Values that nobody shares use up prefix places without being posted at all, which
skips nearly every document that has no partner. Sets that meet are gathered, through the smallest member of each
posting, into candidate groups; within a group each set is looked up in the postings of its prefix, collisions are counted for
the sets it meets there, pairs at or above the match threshold that are not yet connected are confirmed on their full shingle
sets, and only a spanning forest leaves the task. Groups beyond ``block_rows`` are cut by set size and hash into pairs of blocks, so
no task holds an unbounded group and no pair is lost. The price: a group of G sets of like size is about (2G / block_rows)**2 / 2
tasks, and each of its sets travels to 2G / block_rows of them.

Sets hold shingles as 64-bit polynomial hashes of their bytes: sizes and similarities are exact but for collisions (odds of about
n**2 / 2**65 among n distinct shingles of ordinary text; texts built to collide are not guarded against).

Defined results: a null or empty text, or one of only whitespace, has an empty set, links with nothing and is kept.
Repeated rows and equal texts share one class. Rows with a null doc_id are linked, and link others, like any row, but never name a
class; a class of such rows only has a null component_id and all of them kept.
Only ``doc_id`` and ``text`` are read, so further columns with any name are harmless. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from lociweave.llm.common import as_bytes, free_names, map_batches, pick_rows
from lociweave.llm.shingles import mix, shared, shingle_set
from lociweave.operators.components import connected_components
from lociweave.plans.runtime import BROADCAST_ROWS, broadcast_bounded, materialize

COORDINATES = 32
BLOCK_ROWS = 2048
SIGMAS = 5.2
_SENT_NODES = 200_000


def match_threshold(percent: int, coordinates: int = COORDINATES) -> int:
    """Coordinates that a linked pair agrees on, ``SIGMAS`` deviations below the expected number."""
    p = percent / 100
    return max(1, math.floor(coordinates * p - SIGMAS * math.sqrt(coordinates * p * (1 - p))))


def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * coordinates + 1, dtype=np.uint64))
    return seeds[:coordinates] | np.uint64(1), seeds[coordinates:]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each permutation over a set of at least one shingle."""
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * a + b).min(axis=0), out=low)
    return low.view(np.int64)


def node_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, node (128-bit key of the set, null if empty), sig (one value per coordinate)."""

    def kernel(batches):
        a, b = _permutations(coordinates)
        for rb in batches:
            n, node, sig, lens = [], [], [], []
            for raw in rb.column("raw"):
                s = shingle_set(raw.as_py(), words)
                n.append(len(s))
                node.append(node_key(s) if len(s) else None)
                lens.append(coordinates if len(s) else 0)
                if len(s):
                    sig.append(signature(s, a, b))
            flat = np.concatenate(sig) if sig else np.empty(0, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rb.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n_shingles", "node", "sig"]
            )

    return map_batches(as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")), kernel, "doc_id long, n_shingles long, node binary, sig array<long>")


def _prefix_postings(sets: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """node, pos, val: the shared postings within each set's prefix, rarest first."""
    posted = sets.select("node", F.posexplode("sig").alias("pos", "val"))
    common = posted.groupBy("pos", "val").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = posted.join(common, ["pos", "val"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "pos", "val"))).alias("p"))
    room = F.size("p") - F.lit(threshold - 1)  # places of the prefix that values of its own do not fill
    return mine.where(room > 0).select("node", F.explode(F.slice("p", F.lit(1), room)).alias("q")).select("node", "q.pos", "q.val")


def _candidate_groups(sets: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """node, grp: sets that meet in a prefix posting, directly or through others."""
    post = materialize(_prefix_postings(sets, coordinates, threshold), "post")
    lead = post.groupBy("pos", "val").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = post.join(lead, ["pos", "val"]).where(F.col("node") != F.col("lead")).select("node", "lead").distinct()
    return connected_components(edges, "node", "lead").withColumnRenamed("component", "grp")


def _dealt(members: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Adds ``task`` and ``side``: every pair of a group that the size bound allows meets in exactly one task.

    A group of at most ``block_rows`` is one task. A larger one is cut into classes of set size, so wide that linked sets
    are in the same or the next class, and each class into blocks by hash; a task is a pair of blocks.
    """
    whole = lambda df: df.select("doc_id", "node", F.lit(0).alias("side"), F.concat(F.lit("g"), F.hex("grp")).alias("task"))
    sizes = materialize(members.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block_rows), "sizes")
    n = sizes.count()
    if not n:
        return whole(members)
    large = broadcast_bounded(sizes.select("grp"), n)
    small = whole(members.join(large, "grp", "left_anti"))
    width = math.log(100 / percent) * 1.0001
    big = members.join(large, "grp", "left_semi").select("doc_id", "node", "grp", F.floor(F.ln(F.col("n_shingles").cast("double")) / width).alias("cls"))
    blocks = materialize(big.groupBy("grp", "cls").agg(F.ceil(F.count(F.lit(1)) * 2 / block_rows).alias("nb")), "blocks")
    n = blocks.count()
    near = blocks.select("grp", (F.col("cls") - 1).alias("cls"), F.col("nb").alias("above"))
    below = blocks.select("grp", (F.col("cls") + 1).alias("cls"), F.col("nb").alias("below"))
    own = big.join(broadcast_bounded(blocks, n), ["grp", "cls"])
    for side in (near, below):
        own = own.join(broadcast_bounded(side, n), ["grp", "cls"], "left")
    own = own.withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")))
    span = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    cell = lambda side, c, i, d, j: F.struct(F.lit(side).alias("side"), F.concat_ws(":", F.hex("grp"), c.cast("string"), i.cast("string"), d.cast("string"), j.cast("string")).alias("task"))
    cls, blk, zero = F.col("cls"), F.col("blk"), F.lit(0).cast("long")
    # A block against itself has one side; against another block it is side 0 where it comes first, else side 1.
    within = F.transform(span(F.col("nb")), lambda j: F.when(j >= blk, cell(0, cls, blk, cls, j)).otherwise(cell(1, cls, j, cls, blk)))
    up = F.transform(span(F.coalesce("above", zero)), lambda j: cell(0, cls, blk, cls + 1, j))
    down = F.transform(span(F.coalesce("below", zero)), lambda j: cell(1, cls - 1, j, cls, blk))
    cut = own.select("doc_id", "node", F.explode(F.concat(within, up, down)).alias("t")).select("doc_id", "node", "t.side", "t.task")
    return small.union(cut)


def _prefix_rows(sigs: np.ndarray, threshold: int) -> np.ndarray:
    """For each signature the numbers of its rarest coordinate-value pairs within the block, as many as any match must touch."""
    number, often, base = np.empty(sigs.shape, dtype=np.int64), [], 0
    for c in range(sigs.shape[1]):
        _, place, count = np.unique(sigs[:, c], return_inverse=True, return_counts=True)
        number[:, c] = place + base
        often.append(count)
        base += len(count)
    # One order of all pairs, rarest first, decides every prefix alike.
    rank = np.argsort(np.argsort(np.concatenate(often), kind="stable"), kind="stable")[number]
    return np.sort(rank, axis=1)[:, : sigs.shape[1] - threshold + 1]


def confirmed_forest(nodes: list[bytes], sets: list[np.ndarray], sides: np.ndarray, percent: int, threshold: int, coordinates: int = COORDINATES) -> list[tuple[bytes, bytes]]:
    """Links (node, smallest linked node in this task) after confirming pairs on full sets.

    Each set is looked up in the postings of its prefix, which hold the sets before it; only those it meets there get their
    collisions counted. Candidates are tried most collisions first, and one that is already connected is passed over, since another
    link to it would change no class.
    """
    a, b = _permutations(coordinates)
    order = sorted(range(len(nodes)), key=nodes.__getitem__)
    sigs = np.array([signature(sets[i], a, b) for i in order], dtype=np.int64).reshape(len(order), coordinates)
    size = np.array([len(sets[i]) for i in order], dtype=np.int64)
    side = sides[order]
    crossing = bool(side.any())
    parent = list(range(len(order)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    prefix = _prefix_rows(sigs, threshold) if len(order) else np.empty((0, 0), dtype=np.int64)
    _, number, posted = np.unique(prefix, return_inverse=True, return_counts=True)
    begin = np.concatenate([[0], np.cumsum(posted)]).tolist()
    filled = begin[:-1].copy()
    postings = np.empty(begin[-1], dtype=np.int32)
    shared_pairs = [[p for p in row if posted[p] > 1] for row in number.reshape(prefix.shape).tolist()]
    met = np.zeros(len(order), dtype=bool)
    for i, mine in enumerate(shared_pairs):
        met[:i] = False
        for p in mine:
            met[postings[begin[p] : filled[p]]] = True
            postings[filled[p]] = i
            filled[p] += 1
        some = np.flatnonzero(met[:i])
        some = some[100 * np.minimum(size[some], size[i]) >= percent * np.maximum(size[some], size[i])]
        if crossing:
            some = some[side[some] != side[i]]
        if not len(some):
            continue
        hits = (sigs[some] == sigs[i]).sum(axis=1)
        for j in some[np.argsort(-hits, kind="stable")][: int((hits >= threshold).sum())].tolist():
            p, q = root(i), root(j)
            if p == q:
                continue
            both = shared(sets[order[i]], sets[order[j]])
            if 100 * both >= percent * (size[i] + size[j] - both):
                parent[max(p, q)] = min(p, q)
    return [(nodes[order[i]], nodes[order[root(i)]]) for i in range(len(order)) if root(i) != i]


def _links(docs: DataFrame, dealt: DataFrame, words: int, percent: int, threshold: int, coordinates: int) -> DataFrame:
    """hi, lo: confirmed links, at most one per set and task."""
    wanted = dealt.groupBy("doc_id", "node").agg(F.collect_list(F.struct("task", "side")).alias("tasks"))
    wanted = materialize(wanted, "wanted")
    n = wanted.count()
    side = F.broadcast(wanted) if n <= 200_000 else wanted  # about 100 bytes a row
    every = as_bytes(docs, F.col("doc_id").cast("long").alias("doc_id"))

    def rebuild(batches):
        sent: set[bytes] = set()
        for rb in batches:
            node, sets, keep = [], [], []
            asked = rb.column("node") if "node" in rb.schema.names else None
            for i, raw in enumerate(rb.column("raw")):
                s = shingle_set(raw.as_py(), words)
                if not len(s):
                    continue
                key = node_key(s)
                # Copies of a set leave a task about once, so a key that repeats on many rows is no heavy group.
                if key in sent or asked is not None and key != asked[i].as_py():
                    continue
                sent.add(key)
                if len(sent) > _SENT_NODES:
                    sent.clear()
                node.append(key)
                sets.append(s.tobytes())
                keep.append(i)
            columns, names = [pa.array(node, pa.binary()), pa.array(sets, pa.binary())], ["node", "shingles"]
            if asked is not None:
                columns, names = [*columns, rb.column("tasks").take(pa.array(keep, pa.int32()))], [*names, "tasks"]
            yield pa.RecordBatch.from_arrays(columns, names)

    tasks = "tasks array<struct<task:string,side:int>>"
    built = map_batches(every.join(side, "doc_id"), rebuild, f"node binary, shingles binary, {tasks}")
    if wanted.where("doc_id is null").take(1):
        # Sets that only rows without an id have: found by the set itself.
        nameless = map_batches(every.where("doc_id is null").select("raw"), rebuild, "node binary, shingles binary")
        built = built.union(nameless.join(side.where("doc_id is null").drop("doc_id"), "node").select("node", "shingles", "tasks"))
    built = built.select("node", "shingles", F.explode("tasks").alias("t")).select("node", "shingles", "t.task", "t.side")

    def resolve(table: pa.Table) -> pa.Table:
        rows = {}
        for node, raw, s in zip(table["node"].to_pylist(), table["shingles"].to_pylist(), table["side"].to_pylist(), strict=True):
            rows[node] = (np.frombuffer(raw, dtype=np.uint64), s)  # repeated rows of one document meet here
        pairs = confirmed_forest(list(rows), [x[0] for x in rows.values()], np.array([x[1] for x in rows.values()]), percent, threshold, coordinates)
        return pa.table({"hi": pa.array([p[0] for p in pairs], pa.binary()), "lo": pa.array([p[1] for p in pairs], pa.binary())})

    return built.groupBy("task").applyInArrow(resolve, "hi binary, lo binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, coordinates: int = COORDINATES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; see the module's head for the method and edge cases."""
    return _classes(docs, words, percent, coordinates, block_rows).select("doc_id", "n_shingles", "component_id", "kept")


def _classes(docs: DataFrame, words: int, percent: int, coordinates: int = COORDINATES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As ``near_duplicates``, with node and component, the node that tells classes apart (null for an empty set)."""
    threshold = match_threshold(percent, coordinates)
    sigs = materialize(signatures(docs, words, coordinates), "sigs")
    full = sigs.where(F.col("n_shingles") > 0)
    sets = full.select("node", "sig").dropDuplicates(["node"])
    groups = _candidate_groups(sets, coordinates, threshold)
    by_node = full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"))
    by_node = materialize(by_node, "nodes")
    members = by_node.join(groups, "node")
    links = _links(docs, _dealt(members, percent, block_rows), words, percent, threshold, coordinates)
    classes = connected_components(links, "hi", "lo")
    rooted = by_node.join(classes, "node", "left").where((F.col("copies") > 1) | F.col("component").isNotNull())
    rooted = rooted.withColumn("component", F.coalesce("component", "node"))
    smallest = rooted.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    naming = rooted.select("node", "component").join(smallest, "component").select("node", "component", "component_id")
    out = sigs.select("doc_id", "n_shingles", "node").join(naming, "node", "left")
    out = out.select("doc_id", "n_shingles", "node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but the smallest doc_id of each class; of rows with a doc_id that are equal in id and set one stays.

    Rows are told apart by (doc_id, set): other texts under the same id, and rows without an id, are never dropped for the id's sake.
    """
    found = materialize(_classes(docs, words, percent), "classes")
    repeated = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    n = repeated.count()
    many = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    lost = found.where(~F.col("kept") & F.col("doc_id").isNotNull()).join(many, "doc_id", "left_anti").select("doc_id")
    gone = lost.count()
    nulls = bool(found.where("doc_id is null and not kept").take(1))
    plain = pick_rows(docs, lost, "left_anti", gone) if gone else docs
    if not n and not nulls:
        return plain
    if n:
        plain = pick_rows(plain, repeated, "left_anti", n)
    mixed = pick_rows(docs, repeated, "left_semi", n)
    if nulls:
        plain, mixed = plain.where("doc_id is not null"), mixed.union(docs.where("doc_id is null"))
    own_id, own_set, key = free_names(docs, "own_id", "own_set", "set_key")
    # Of a class whose smallest id is on several sets, one set stands for the class.
    named = found.where(F.col("doc_id") == F.col("component_id")).groupBy("component").agg(F.min("node").alias("stands"))
    verdict = found.where("kept").join(many, "doc_id", "left_semi").where("node is not null").join(named, "component").where("node = stands").select("doc_id", "node")
    verdict = verdict.union(found.where("kept and doc_id is not null and node is null").join(many, "doc_id", "left_semi").select("doc_id", "node"))
    verdict = verdict.union(found.where("kept and doc_id is null").select("doc_id", "node")).distinct().toDF(own_id, own_set)
    keyed = _with_sets(mixed, words, key)
    keyed = keyed.join(verdict, F.col("doc_id").eqNullSafe(F.col(own_id)) & F.col(key).eqNullSafe(F.col(own_set)), "left_semi")
    thinned = keyed.where("doc_id is not null").dropDuplicates(["doc_id", key]).union(keyed.where("doc_id is null"))
    return plain.union(thinned.select(*docs.columns))


def _with_sets(docs: DataFrame, words: int, name: str) -> DataFrame:
    """The documents with the key of their shingle set in the column ``name``, null if it is empty."""

    def kernel(batches):
        for rb in batches:
            sets = [shingle_set((x or "").encode(), words) for x in rb.column(rb.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([node_key(s) if len(s) else None for s in sets], pa.binary())], schema=rb.schema.append(pa.field(name, pa.binary())))

    return map_batches(docs, kernel, StructType([*docs.schema.fields, StructField(name, BinaryType())]))
