"""Near duplicates by SimHash fingerprints and a self-join of their binary trie.

Equal fingerprints are collapsed first, so a group of copies costs one node however large it is. The distinct
fingerprints form a binary trie. Its upper levels are dealt out by Spark: a fingerprint goes to every subtree whose
prefix differs from its own in no more bits than the budget. Inside a task the two subtrees are walked together, pair
of nodes by pair of nodes, adding up the bits in which the branches differ and leaving a pair as soon as the budget is
exceeded. A task keeps a spanning forest of the links it finds; components come from ``components``.

Null and blank texts have no words: their fingerprint is zero and they are linked like any other. Null ids are kept
and never name a component that has another id. Repeated rows are kept, one row out per row in. An empty table gives
no rows. Other columns of the input are ignored (``keep_one_per_group`` returns them).

Very long texts are fingerprinted whole, a bounded number of shingles at a time. A bit that half the hashes have is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tillwright.llm.common import stage_compressed, whole_text
from tillwright.llm.components import component_roots
from tillwright.plans.staging import broadcast_if_small

SHINGLE_WORDS = 3
SEED = 42
BUDGET = 3
# Distinct fingerprints per subtree to aim for, and how many a task may hold of one subtree before it is cut further.
SUBTREE = 4_096
# The trie is dealt out at this depth at least, so that small inputs spread over tasks in the same way as larger ones.
LEAST_DEPTH = 8
CROWDED = 4 * SUBTREE
# Shingles whose bits are counted at once: 64 bytes each.
AT_ONCE = 1 << 15
# Walk this many fingerprints of the left subtree at a time, and compare directly below this many pairs.
WALK, DIRECT = 512, 32


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the word shingles: a bit is set if it is set in over half the shingle hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), AT_ONCE):
        spans = zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE], strict=True)
        hashes = np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in spans]), np.uint8).reshape(-1, 8)
        total += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprint_column(texts):
    """The fingerprint's 64 bits as a signed integer."""
    bits = np.array([fingerprint(text) for text in texts], np.uint64)
    return texts.__class__(bits.view(np.int64))


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


class _Trie:
    """Sorted distinct fingerprints; a node is a range of them, split by the next bit."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self._ones: dict[int, np.ndarray] = {}

    def split(self, level: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where, in each range with a common prefix of ``level`` bits, the next bit becomes one."""
        if level not in self._ones:
            bits = (self.values >> np.uint64(63 - level)) & np.uint64(1)
            self._ones[level] = np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]).astype(np.int32)
        ones = self._ones[level]
        return high - (ones[high] - ones[low])


def linked_pairs(left: np.ndarray, right: np.ndarray, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Value pairs (a, b), a < b, a of ``left``, b of ``right``, that differ in at most ``budget`` bits."""
    other = _Trie(right)
    for start in range(0, len(left), WALK):
        own = _Trie(left[start : start + WALK])
        a0, a1 = np.zeros(1, np.int32), np.full(1, len(own.values), np.int32)
        b0, b1, spent = np.zeros(1, np.int32), np.full(1, len(right), np.int32), np.zeros(1, np.int8)
        for level in range(65):
            small = (a1 - a0).astype(np.int64) * (b1 - b0) <= DIRECT if level < 64 else np.ones(len(a0), bool)
            if small.any():
                yield from _compare(own.values, right, a0[small], a1[small], b0[small], b1[small], budget)
            a0, a1, b0, b1, spent = (x[~small] for x in (a0, a1, b0, b1, spent))
            if not len(a0):
                break
            am, bm = own.split(level, a0, a1), other.split(level, b0, b1)
            a0, a1 = np.concatenate([a0, am, a0, am]), np.concatenate([am, a1, am, a1])
            b0, b1 = np.concatenate([b0, bm, bm, b0]), np.concatenate([bm, b1, b1, bm])
            spent = np.concatenate([spent, spent, spent + 1, spent + 1])
            alive = (a0 < a1) & (b0 < b1) & (spent <= budget)
            a0, a1, b0, b1, spent = (x[alive] for x in (a0, a1, b0, b1, spent))


def _compare(left, right, a0, a1, b0, b1, budget) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all values of small node pairs."""
    width = b1 - b0
    pairs = ((a1 - a0) * width).astype(np.int64)
    node = np.repeat(np.arange(len(pairs)), pairs)
    within = np.arange(len(node)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    row, column = np.divmod(within, width[node])
    a, b = left[a0[node] + row], right[b0[node] + column]
    near = (np.bitwise_count(a ^ b) <= budget) & (a < b)
    if near.any():
        yield a[near], b[near]


class _Forest:
    """Union-find that tells which links joined two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def _root(self, node: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = node = parent.setdefault(up, up)
        return node

    def joins(self, a: int, b: int) -> bool:
        a, b = self._root(a), self._root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _join_subtrees(group: pa.Table) -> pa.Table:
    """Links of one left subtree (or a cut of it) with itself and the subtrees dealt to it, as a spanning forest."""
    bits = group.column("bits").to_numpy().view(np.uint64)
    own = group.column("own").to_numpy(zero_copy_only=False).astype(bool)
    left, right = np.unique(bits[own]), np.unique(bits)
    forest, kept = _Forest(), []
    if len(left):
        for a, b in linked_pairs(left, right):
            kept += [pair for pair in zip(a.tolist(), b.tolist(), strict=True) if forest.joins(*pair)]
    ends = np.array(kept, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": pa.array(ends[:, 0].copy(), pa.int64()), "b": pa.array(ends[:, 1].copy(), pa.int64())})


def trie_links(
    nodes: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE, crowded: int = CROWDED, least_depth: int = LEAST_DEPTH
) -> DataFrame:
    """Links between distinct fingerprints (column ``bits``): enough of them to connect every component.

    The prefix length follows the number of fingerprints. A subtree that holds many times its share is cut into
    pieces, on both sides of the join, so that no task gets more than a bounded part of it.
    """
    rows = nodes.count()
    depth = min(24, max(least_depth, math.ceil(math.log2(max(1, rows / subtree)))))
    masks = [sum(1 << bit for bit in bits) for k in range(min(budget, depth) + 1)
             for bits in combinations(range(depth), k)]
    prefix = F.shiftrightunsigned("bits", 64 - depth) if depth else F.lit(0).cast("bigint")
    keyed = nodes.select("bits", prefix.alias("prefix"))
    pieces = (
        keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > crowded)
        .select("prefix", F.ceil(F.col("n") / subtree).cast("int").alias("pieces"))
    )
    near = F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.col("prefix").bitwiseXOR(m))
    # How many pieces the fingerprints that meet a subtree may come in: the most of any subtree near it.
    around = (
        pieces.select("prefix", "pieces", F.explode(near).alias("target"))
        .groupBy("target").agg(
            F.max(F.when(F.col("target") == F.col("prefix"), F.col("pieces")).otherwise(1)).alias("left_pieces"),
            F.max("pieces").alias("right_pieces"),
        )
    )
    around = broadcast_if_small(stage_compressed(around, "crowded-subtrees"))
    pieces = broadcast_if_small(stage_compressed(pieces, "cut-subtrees"))
    mix = F.pmod(F.xxhash64("bits"), F.coalesce("pieces", F.lit(1)))
    dealt = (
        keyed.join(pieces, "prefix", "left").select("bits", "prefix", mix.cast("int").alias("piece"))
        .select("bits", "prefix", "piece", F.explode(near).alias("target"))
        .filter("target <= prefix")
        .join(around, "target", "left")
    )
    # A fingerprint stands on the right of each left piece, and, in its own subtree, on the left of each right piece.
    everywhere = F.transform(
        F.sequence(F.lit(0), F.coalesce("left_pieces", F.lit(1)) - 1),
        lambda i: F.struct(i.alias("i"), F.col("piece").alias("j"), F.lit(False).alias("own")),
    )
    at_home = F.transform(
        F.sequence(F.lit(0), F.coalesce("right_pieces", F.lit(1)) - 1),
        lambda j: F.struct(F.col("piece").alias("i"), j.alias("j"), F.lit(True).alias("own")),
    )
    places = F.when(F.col("target") == F.col("prefix"), F.concat(at_home, everywhere)).otherwise(everywhere)
    return (
        dealt.select("bits", "target", F.explode(places).alias("place"))
        .select("bits", "target", "place.*")
        .groupBy("target", "i", "j")
        .applyInArrow(_join_subtrees, "a bigint, b bigint")
    )


def components_of(fingerprints: DataFrame) -> DataFrame:
    """(bits, root, component_id) per distinct fingerprint of a staged table ``doc_id, bits``."""
    nodes = stage_compressed(fingerprints.groupBy("bits").agg(F.min("doc_id").alias("first_doc")), "fingerprints")
    roots = component_roots(trie_links(nodes))
    rooted = stage_compressed(
        nodes.join(roots, nodes["bits"] == roots["node"], "left")
        .select("bits", "first_doc", F.coalesce("root", "bits").alias("root")),
        "rooted",
    )
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return rooted.join(least, "root").select("bits", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fingerprint as 16 hex digits, and the smallest doc_id reachable over links."""
    bits = fingerprint_column(whole_text())
    own = stage_compressed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), bits.alias("bits")), "simhash")
    groups = components_of(own)
    return own.join(groups, "bits").select("doc_id", as_hex(F.col("bits")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with one row left of each component: the one with the smallest id.

    Components are those of ``near_duplicates``: three-word shingles, at most ``BUDGET`` differing bits, nothing else.
    Rows that repeat that id inside the component leave the first of them by text and the other columns.
    """
    bits = fingerprint_column(whole_text())
    own = stage_compressed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), bits.alias("bits")), "simhash")
    groups = stage_compressed(components_of(own), "groups")
    # Only rows whose id names their group come into question; the text is moved for them alone.
    chosen = (
        own.join(groups, "bits").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("doc_id", "root").agg(F.min("bits").alias("bits"))
    )
    names = docs.columns
    row = F.struct(*[F.col(f"`{name}`") for name in names])
    candidates = docs.select(row.alias("row")).select(
        "row", F.col("row.doc_id").cast("bigint").alias("id"), fingerprint_column(F.coalesce("row.text", F.lit(""))).alias("bits")
    )
    matched = candidates.join(
        chosen.select(F.col("doc_id").alias("chosen_id"), F.col("bits").alias("chosen_bits"), "root"),
        (F.col("bits") == F.col("chosen_bits")) & F.col("id").eqNullSafe(F.col("chosen_id")),
    )
    first = Window.partitionBy("chosen_id", "root").orderBy("row.text", F.xxhash64(F.to_json("row")))
    kept = matched.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return kept.select([F.col(f"row.`{name}`").alias(name) for name in names])
