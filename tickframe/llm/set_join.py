"""N-gram Jaccard join by chosen paths.

A text is the set of its word 5-grams. In each run, a set takes the SAMPLE tokens that a seeded hash puts lowest; sets
that took the same token, and whose sizes allow the threshold, share a bucket. Two sets of similarity s miss each other in a run with probability of about
(1 - s) ** SAMPLE, so runs_for(target) runs reach the target recall at the threshold.

Buckets of up to BUCKET sets are compared by brute force. A larger one whose members agree on few of their sampled
tokens is split again by further sampled tokens; one whose members agree on most (near copies) is not worth splitting
and is compared in pairs of blocks, as is what stays large at MAX_DEPTH. Every pair of a bucket is verified exactly.

Equal texts are one set throughout. A pair that shares several buckets counts in the smallest of them only, so buckets
give link counts and spanning edges instead of pairs: what leaves a bucket is in proportion to its members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, fresh, join_counted, release, settle, shuffle_partitions, tidied, words_of

NGRAM = 5
THRESHOLD = (4, 5)  # similarity of at least 4 / 5
SAMPLE = 4
TARGET_RECALL = 0.99999
BUCKET = 400
#: Sets and tokens that a task holds of each of two blocks, about.
BLOCK, BLOCK_TOKENS = 1_500, 1_500_000
#: Sizes within the threshold's ratio (5 / 4) fall into the same or neighbouring powers of this; a little more, for rounding.
SIZE_STEP = 1.26
MAX_DEPTH = 2
#: Share of sampled tokens that two members of a bucket have in common, on average, from which the bucket counts as dense.
DENSE = 0.3

U = np.uint64
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], U)


def runs_for(target: float, sample: int = SAMPLE) -> int:
    miss = (1 - THRESHOLD[0] / THRESHOLD[1]) ** sample
    return max(1, math.ceil(math.log(1 - target) / math.log(miss)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seed_of(run: int) -> np.uint64:
    return mix(np.array([run + 1], U) * _MUL[0])[0]


def tokens_of(text: str | None) -> np.ndarray:
    """The distinct word 5-grams of a text as sorted 64-bit hashes; fewer than five words are one gram, none give none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, U)
    if len(words) < NGRAM:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    n = len(h) - NGRAM + 1
    total = np.zeros(n, U)
    for k in range(NGRAM):
        total += mix(h[k : k + n] * _MUL[k])
    return np.unique(mix(total))


def lowest(tokens: np.ndarray, seed, n: int = SAMPLE) -> np.ndarray:
    """The n lowest seeded hashes of the tokens: names of the paths a set takes."""
    hashed = mix(tokens ^ U(seed))
    return hashed if len(hashed) <= n else np.partition(hashed, n - 1)[:n]


def _texts(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, own (JVM hash of the text, to find the row again), digest, n (set size), paths; no text. Evaluated once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def sketch(batches):
        seeds = [seed_of(r) for r in range(runs)]
        for batch in batches:
            digests, sizes, paths = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                tokens = tokens_of(text)
                digests.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                sizes.append(len(tokens))
                paths.append(np.concatenate([lowest(tokens, s) for s in seeds]).astype(np.int64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("own"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(paths, pa.list_(pa.int64()))], ["doc_id", "own", "digest", "n", "paths"])

    return settle(rows.mapInArrow(tidied(sketch), "doc_id long, own long, digest binary, n int, paths array<bigint>"))


def _shared(rows: DataFrame) -> DataFrame:
    """rows (path, digest, n) of buckets with two members or more, with the bucket's size and tokens; of buckets with the same members one stays."""
    one, two = F.bit_xor(F.xxhash64("digest")), F.bit_xor(F.xxhash64("digest", F.lit(1)))
    sizes = rows.groupBy("path").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), one.alias("x"), two.alias("y")).filter("size > 1")
    first = sizes.groupBy("size", "weight", "x", "y").agg(F.min("path").alias("path")).select("path", "size", "weight")
    return settle(rows.join(first, "path"))


def _density(big: DataFrame, texts: DataFrame) -> DataFrame:
    """path, dense: whether members of a bucket agree on most of their sampled tokens."""
    each = big.join(texts.select("digest", F.explode("paths").alias("q")), "digest")
    same = each.groupBy("path", "size", "q").agg(F.count("*").alias("c")).groupBy("path", "size").agg(F.sum(F.col("c") * (F.col("c") - 1.0)).alias("pairs"), F.sum("c").alias("taken"))
    share = F.col("pairs") / ((F.col("size") - 1.0) * F.col("taken"))
    return same.select("path", (share >= DENSE).alias("dense"))


def _children(big: DataFrame, sets: DataFrame) -> DataFrame:
    """(path, digest, n) of the buckets below sparse large ones: each member takes the lowest of its tokens by a hash that its path seeds."""

    def split(batches):
        for batch in batches:
            paths, digests, sizes = [], [], []
            for path, digest, tokens in zip(batch.column("path").to_pylist(), batch.column("digest").to_pylist(), batch.column("tokens"), strict=True):
                seed = mix(np.array([path], np.int64).view(U))[0]
                # One more than at the root: the token all members share by their path is among them at worst.
                for p in lowest(np.frombuffer(tokens.as_buffer(), U), seed, SAMPLE + 1).astype(np.int64).tolist():
                    paths.append(p)
                    digests.append(digest)
                    sizes.append(len(tokens.as_buffer()) // 8)
            yield pa.record_batch([pa.array(paths, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32())], ["path", "digest", "n"])

    return big.join(sets, "digest").select("path", "digest", "tokens").mapInArrow(tidied(split), "path long, digest binary, n int")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, whole: bool) -> list[tuple[int, int]]:
    """The pairs (i, j) of similarity of at least THRESHOLD, i of left and j of right; whole: left is right, and i < j."""
    sizes = np.array([len(s) for s in sets], np.int64)
    up, down = THRESHOLD
    if len(left) * len(right) <= 36:
        out = []
        for i in left.tolist():
            for j in right.tolist():
                if (not whole or i < j) and down * min(sizes[i], sizes[j]) >= up * max(sizes[i], sizes[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both and (up + down) * both >= up * (sizes[i] + sizes[j]):
                        out.append((i, j))
        return out
    used = np.unique(np.concatenate([left, right]))
    tokens, of, counts = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    owner = np.repeat(used, sizes[used])
    shared = counts > 1  # a token of one set is in no intersection
    order = np.cumsum(shared) - 1
    keep = shared[of]
    cols, owner = order[of[keep]], owner[keep]
    at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
    at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    by_col = np.argsort(cols, kind="stable")
    cols, owner = cols[by_col], owner[by_col]
    step = 4096
    for first in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(cols, [first, first + step])
        c, o = cols[a:b] - first, owner[a:b]
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        x[at_left[o][at_left[o] >= 0], c[at_left[o] >= 0]] = 1
        y[at_right[o][at_right[o] >= 0], c[at_right[o] >= 0]] = 1
        both += x @ y.T
    near = (both > 0) & ((up + down) * both.astype(np.int64) >= up * (sizes[left][:, None] + sizes[right][None, :]))
    return [(i, j) for i, j in zip(left[np.nonzero(near)[0]].tolist(), right[np.nonzero(near)[1]].tolist(), strict=True) if not whole or i < j]


def _verify(members: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Brute force over buckets: (digest, links, root) rows; root links the member to another of its group, or is null.

    Blocks of a large bucket meet in pairs, so a task never holds more than two blocks.
    """
    homes = members.groupBy("digest").agg(F.sort_array(F.collect_set("path")).alias("homes"))
    n_blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_TOKENS)).cast("int")
    dealt = members.withColumn("blocks", n_blocks).withColumn("block", F.expr("cast(pmod(xxhash64(digest, 7), blocks) as int)"))
    whole = dealt.filter("blocks = 1").withColumn("other", F.lit(0))
    dealt = whole.unionByName(dealt.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = dealt.select("path", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "digest")
    full = dealt.join(homes, "digest").join(sets, "digest").select("path", "a", "b", "block", "digest", "homes", "tokens")
    laid = full.repartition(parts, "path", "a", "b").sortWithinPartitions("path", "a", "b")

    def run(batches):
        key, group = None, []

        def flush():
            digests = [g[1] for g in group]
            sets_ = [np.frombuffer(g[3], U) for g in group]
            _, a, b = key
            blocks = np.array([g[0] for g in group])
            left, right = np.nonzero(blocks == a)[0], np.nonzero(blocks == b)[0]
            links, up = np.zeros(len(group), np.int64), list(range(len(group)))

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = up[i]
                return i

            homes_ = [set(g[2]) for g in group]
            for i, j in linked(sets_, left, right, a == b):
                if len(homes_[i]) > 1 and len(homes_[j]) > 1 and min(homes_[i] & homes_[j]) != key[0]:
                    continue
                links[i] += 1
                links[j] += 1
                x, y = top(i), top(j)
                if x != y:
                    x, y = (x, y) if digests[x] < digests[y] else (y, x)
                    up[y] = x
            have = np.nonzero(links)[0].tolist()
            return [(digests[i], int(links[i]), digests[top(i)] if top(i) != i else None) for i in have]

        def batch_of(rows):
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["digest", "links", "root"])

        done: list = []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("path", "a", "b", "block", "digest", "homes", "tokens")]
            for path, a, b, *rest in zip(*cols, strict=True):
                if (path, a, b) != key:
                    if len(group) > 1:
                        done += flush()
                    key, group = (path, a, b), []
                    if len(done) > 5000:
                        yield batch_of(done)
                        done = []
                group.append(rest)
        if len(group) > 1:
            done += flush()
        if done:
            yield batch_of(done)

    return laid.mapInArrow(tidied(run), "digest binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for the nodes of edges (a, b).

    Large-star and small-star rounds, until every node has one smaller neighbour at most and none has both smaller and
    larger ones: then the edges point from each node to its root.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        open_, most, total = nodes.agg(F.count_if(F.expr("up > 1 or (up = 1 and down > 0)")), F.coalesce(F.max(F.col("up") + F.col("down")), F.lit(0)), F.coalesce(F.sum(F.col("up") + F.col("down")), F.lit(0))).first()
        if not open_:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # Each larger neighbour of a node, and the node itself, meet its smallest neighbour.
        large = both.withColumn("own", F.lit(False)).unionByName(both.select("a", F.col("a").alias("b"), F.lit(True).alias("own")).distinct())
        met = join_counted(large, least, "a", "n", total) if most * HOT_KEYS > total > HOT_KEYS else large.join(least, "a")  # a hub's edges are not one task's
        large = settle(met.filter("b > a or own").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        release(now)
        small = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        now = settle(large.join(small, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("c").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct())
        release(large)


def join_sets(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """For each row of docs: doc_id, own, class_id, class_own, n_links, copy_of, n_copies.

    copy_of is the smallest doc_id with the same text and n_copies the rows that have it; n_links counts the other texts
    of similarity 0.8 or more; class_id is the smallest doc_id of all that copies and links connect. Texts without a word
    have no links; they are copies of their like. A null text counts as empty; rows that repeat id and text are copies of
    each other; texts of any length are whole sets; other columns are ignored. Null ids are never a smallest id unless
    all are null. own is Spark's xxhash64 of the text, and class_own that of the text class_id stands for.
    """
    texts = _texts(docs, runs_for(target_recall))
    parts = shuffle_partitions(docs.sparkSession)
    distinct = settle(texts.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "own")).alias("rep"), F.first("paths").alias("paths"), F.first("n").alias("n"), F.count("*").alias("n_copies")))
    # A path goes with a size class and with the next one: similar sizes have at least one of them in common.
    size_class = F.floor(F.log("n") / math.log(SIZE_STEP))
    taken = distinct.select("digest", "n", F.explode(F.array_distinct("paths")).alias("p")).select("digest", "n", "p", F.explode(F.array(size_class, size_class + 1)).alias("c"))
    shared = _shared(taken.select(F.xxhash64("p", "c").alias("path"), "digest", "n"))
    # The sets of texts that share a bucket are made again from their texts, once; no other set is ever stored.
    wanted = shared.select("digest").distinct().join(distinct, "digest").select("digest", F.col("rep.doc_id").alias("of"), F.col("rep.own").alias("of_own"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("own"), F.col("text").cast("string").alias("text"))
    again = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("own") == F.col("of_own"))).select("digest", "text")

    def sets_of(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("digest"), pa.array([tokens_of(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], ["digest", "tokens"])

    sets = again.mapInArrow(tidied(sets_of), "digest binary, tokens binary")
    if not texts.groupBy("doc_id", "own").count().filter("count > 1").isEmpty():
        sets = sets.dropDuplicates(["digest"])  # rows that repeat id and text
    sets = settle(sets)
    leaves, level = shared.filter(F.col("size") <= BUCKET), shared.filter(F.col("size") > BUCKET)
    for depth in range(MAX_DEPTH):
        if level.isEmpty():
            break
        judged = settle(level.join(_density(level, distinct), "path"))
        leaves = leaves.unionByName(judged.filter("dense").drop("dense"))
        level = _shared(settle(_children(judged.filter(~F.col("dense")), sets).distinct()))
        if depth + 1 < MAX_DEPTH:
            leaves = leaves.unionByName(level.filter(F.col("size") <= BUCKET))
            level = level.filter(F.col("size") > BUCKET)
    leaves = settle(leaves.unionByName(level))
    found = settle(_verify(leaves, sets, parts))
    links = found.groupBy("digest").agg(F.sum("links").alias("n_links"))
    groups = components(found.filter("root is not null").select(F.col("digest").alias("a"), F.col("root").alias("b")))
    # Only linked texts go through what follows; all others stand for themselves.
    grouped = settle(groups.select(F.col("node").alias("digest"), "root").join(distinct.select("digest", "rep"), "digest"))
    classes = grouped.groupBy("root").agg(F.min("rep").alias("least"))
    linked_texts = grouped.select("digest", "root").join(classes, "root").select("digest", "least").join(links, "digest")
    told = distinct.select("digest", "rep", "n_copies").join(linked_texts, "digest", "left")
    least = F.coalesce("least", "rep")
    named = told.select("digest", least["doc_id"].alias("class_id"), least["own"].alias("class_own"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("rep.doc_id").alias("copy_of"), "n_copies")
    named = settle(named)
    for done in (distinct, shared, sets, leaves, found, grouped):
        release(done)
    # A text that a third of all rows copy is met by broadcast, not in one task.
    return join_counted(texts.select("doc_id", "own", "digest"), named, "digest", "n_copies", texts.count()).select("doc_id", "own", "class_id", "class_own", "n_links", "copy_of", "n_copies")


def keep_one(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id; all columns stay."""
    told = settle(join_sets(docs, target_recall)).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("own") == F.col("class_own")))
    goes = told.filter("not stays").select(F.col("doc_id").alias("of"), F.col("own").alias("of_own")).distinct()
    own = F.xxhash64(docs["text"].cast("string"))
    kept = docs.join(goes, docs["doc_id"].eqNullSafe(goes["of"]) & (own == goes["of_own"]), "left_anti")
    # Rows that repeat id and text all stand for their class; one of them stays.
    if told.filter("stays").groupBy("class_id", "class_own").count().filter("count > 1").isEmpty():
        return kept
    name = fresh(docs.columns)
    return kept.withColumn(name, own).dropDuplicates(["doc_id", name]).drop(name)
