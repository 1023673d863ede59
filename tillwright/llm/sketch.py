"""Document fingerprints as invertible Bloom lookup tables, in DataFrame expressions only.

A fingerprint is a small table of cells. Every distinct paragraph digest is added to one cell of each of three rows:
the cell keeps how many digests it holds, their exclusive or, and the exclusive or of their checksums. Subtracting
two fingerprints cell by cell leaves only digests that differ; cells that hold a single digest are peeled, which opens
further ones, until all differing digests are recovered. Where the peeling gets stuck, the pair is sketched again with
more cells (in proportion to the digests on both sides, doubled once more at the next failure), and pairs that still
fail are compared by their digests. Likeness is the Jaccard similarity of the paragraph sets, 1 for two empty sets.

A paragraph is a line; inside a line a new one also starts at a sentence with a first letter of A to E, a cut that
depends on the content alone. Order and repetition of paragraphs don't count, blank ones are left out.

Null texts are empty. Null ids come first in the order of documents; rows with equal ids are ordered by text. A single
document is its own next one. An empty table gives no rows. Other columns of the input are ignored.

Very long texts are cut into paragraphs in their own row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import stage_compressed, whole_text

# Content-defined ends of paragraphs.
PARAGRAPH_END = r"\n+|(?<=[.!?]) +(?=[A-E])"
ROWS = 3
# Cells per row of the fingerprint; it recovers about 35 differing digests.
BASE_CELLS = 16
# Peeling rounds over all rows of a sketch before it counts as failed.
ROUNDS = 2
# Cells per row for each digest of the pair at the retries.
FIRST_RETRY, SECOND_RETRY = 2, 8
# Digests that one task sketches, so that its cells fit in memory; beyond MOST_TASKS they spill.
TASK_DIGESTS, MOST_TASKS = 150_000, 20_000
# Documents per slice of the id order, and the most slices (their bounds are literals of the plan).
SLICE_DOCS, MAX_SLICES = 2_000, 4_096


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    kept = F.filter(F.split(text, PARAGRAPH_END), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(kept, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cell(key: Column, row: int, cells: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(row)), cells).cast("int")


def _pure(n: Column, key: Column, check: Column) -> Column:
    return (F.abs(n) == 1) & (check == _check(key))


def _sketch(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Cells from rows (keys.., key, sign, cells): one hash aggregate over three entries per digest."""
    entries = F.array(*[
        F.struct(F.lit(row).alias("row"), _cell(F.col("key"), row, F.col("cells")).alias("cell")) for row in range(ROWS)
    ])
    return (
        keyed.select(*keys, "cells", "key", "sign", F.explode(entries).alias("at"))
        .groupBy(*keys, "cells", F.col("at.row").alias("row"), F.col("at.cell").alias("cell"))
        .agg(F.sum("sign").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor(_check(F.col("key"))).alias("check"))
    )


def _peel(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Recovered digests and cells left over per sketch. A pure cell takes its digest out of all rows.

    Rows are peeled in turn: within a row a digest has one cell, so no digest is taken out twice. Recovered digests
    are counted in a row of their own (-1).
    """
    state = cells.filter("n <> 0 or key <> 0")
    for step in range(ROUNDS * ROWS):
        taken = [
            F.struct(F.lit(row).alias("row"), _cell(F.col("key"), row, F.col("cells")).alias("cell"),
                     (-F.col("n")).alias("n"), F.col("key").alias("key"), F.col("check").alias("check"))
            for row in range(ROWS)
        ]
        tally = F.struct(F.lit(-1).alias("row"), F.lit(0).alias("cell"), F.lit(1).cast("bigint").alias("n"),
                         F.lit(0).cast("bigint").alias("key"), F.lit(0).cast("bigint").alias("check"))
        same = F.struct("row", "cell", "n", "key", "check")
        opens = (F.col("row") == step % ROWS) & _pure(F.col("n"), F.col("key"), F.col("check"))
        state = (
            state.select(*keys, "cells", F.explode(F.when(opens, F.array(same, *taken, tally)).otherwise(F.array(same)))
                         .alias("entry"))
            .groupBy(*keys, "cells", F.col("entry.row").alias("row"), F.col("entry.cell").alias("cell"))
            .agg(F.sum("entry.n").alias("n"), F.bit_xor("entry.key").alias("key"),
                 F.bit_xor("entry.check").alias("check"))
            .filter("row < 0 or n <> 0 or key <> 0")
        )
    return state.groupBy(*keys).agg(
        F.sum(F.when(F.col("row") < 0, F.col("n")).otherwise(0)).alias("recovered"),
        F.count_if(F.col("row") >= 0).alias("left"),
    )


def _bounds(ids: DataFrame) -> list[int]:
    """Ascending ids that cut the order of documents into slices of about equal size."""
    rows = ids.count()
    slices = min(MAX_SLICES, max(1, math.ceil(rows / SLICE_DOCS)))
    if slices == 1:
        return []
    cuts = [i / slices for i in range(1, slices)]
    return sorted(set(ids.select(F.percentile_approx("doc_id", cuts, max(10_000, 4 * slices))).first()[0] or []))


def _slice_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds up to the id, found in two levels; null ids come first."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[at : at + width] for at in range(0, len(bounds), width)]
    literal = lambda values: "array(" + ",".join(f"{v}L" for v in values) + ")"
    heads = F.expr(literal([group[0] for group in groups]))
    group = F.size(F.filter(heads, lambda b: b <= doc_id)) - 1
    fine = F.expr("array(" + ",".join(literal(g) for g in groups) + ")")
    inside = F.size(F.filter(F.element_at(fine, F.greatest(group, F.lit(0)) + 1), lambda b: b <= doc_id))
    return F.when(group < 0, 0).otherwise(group * width + inside)


def with_next_text(docs: DataFrame) -> DataFrame:
    """Add to every row the text of the next document in ascending id order; after the last comes the first.

    The order is cut into slices; the text moves once, to its slice. The first document of a slice also goes to the
    slice before, as the next one of its last document.
    """
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text"))
    bounds = _bounds(chosen.select("doc_id"))
    sliced = chosen.withColumn("slice", _slice_of(F.col("doc_id"), bounds))
    # At most MAX_SLICES rows.
    firsts = sorted(
        (row["slice"], row["first"]) for row in sliced.groupBy("slice").agg(
            F.when(F.count_if(F.col("doc_id").isNull()) > 0, None).otherwise(F.min("doc_id")).alias("first")
        ).collect()
    )
    before = [(first, firsts[at - 1][0]) for at, (_, first) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "first bigint, before int")
    copies = F.array(
        F.struct(F.col("slice"), F.lit(False).alias("guest")),
        F.struct(F.col("before").alias("slice"), F.lit(True).alias("guest")),
    )
    dealt = (
        sliced.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("first")), "left")
        .select("doc_id", "text", F.explode(copies).alias("place")).filter("place.slice is not null")
        .select("place.slice", "place.guest", "doc_id", "text")
    )
    order = Window.partitionBy("slice").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter("not guest").select(
        "doc_id", "text", "next_text"
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last half of the code points (rounded down) replaced by as many first ones of the following text."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(following, half))


def _as_text(cells: Column) -> Column:
    """A sketch as text: row, cell, count, digest and checksum of each cell that is not empty, in order."""
    parts = F.transform(
        F.array_sort(cells),
        lambda c: F.concat(
            F.hex(c["row"] * BASE_CELLS + c["cell"]), F.lit(":"), c["n"].cast("string"), F.lit(":"),
            F.hex(c["key"]), F.lit(":"), F.hex(c["check"].bitwiseAND(0xFFFFFFFF)),
        ),
    )
    return F.array_join(parts, " ")


def _tasks(digests: int) -> int:
    return min(MOST_TASKS, 1 + digests // TASK_DIGESTS)


def fingerprints(rows: DataFrame, versions: list[str], digests: int) -> DataFrame:
    """(rid, one text per version) from rows (rid, one array of digests per version); rows move once, by rid."""
    each = F.array(*[
        F.struct(F.lit(at).alias("version"), F.col(name).alias("digests")) for at, name in enumerate(versions)
    ])
    keyed = (
        rows.select("rid", *versions).repartition(_tasks(digests), "rid").select("rid", F.explode(each).alias("v"))
        .select("rid", "v.version", F.explode("v.digests").alias("key"), F.lit(1).cast("bigint").alias("sign"),
                F.lit(BASE_CELLS).alias("cells"))
    )
    cells = _sketch(keyed, ["rid", "version"])
    cell = F.struct("row", "cell", "n", "key", "check")
    return cells.groupBy("rid").agg(*[
        _as_text(F.collect_list(F.when(F.col("version") == at, cell))).alias(name) for at, name in enumerate(versions)
    ])


def _differences(pairs: DataFrame, cells: Column) -> DataFrame:
    """(pid, differ) by subtracting and peeling sketches of the given size; null where the peeling got stuck."""
    signed = F.concat(
        F.transform("plus", lambda k: F.struct(k.alias("key"), F.lit(1).cast("bigint").alias("sign"))),
        F.transform("minus", lambda k: F.struct(k.alias("key"), F.lit(-1).cast("bigint").alias("sign"))),
    )
    keyed = pairs.select("pid", cells.cast("int").alias("cells"), F.explode(signed).alias("e")).select(
        "pid", "cells", "e.key", "e.sign"
    )
    peeled = _peel(_sketch(keyed, ["pid"]), ["pid"])
    return peeled.select("pid", F.when(F.col("left") == 0, F.col("recovered")).otherwise(-1).alias("outcome"))


def likeness(pairs: DataFrame, digests: int) -> DataFrame:
    """(pid, likeness) of rows (pid, plus, minus): a unique number and two arrays of distinct digests, in all
    ``digests`` of them.

    An attempt moves its pairs once, by pid, and finds its cells in place. Its outcome is stored with the digests of
    the pairs that stay open, which the next attempt takes; those left at the end are compared digest by digest.
    """
    size = F.size("plus") + F.size("minus")
    by_digest = F.size(F.array_except("plus", "minus")) + F.size(F.array_except("minus", "plus"))
    still, parts = pairs, []
    for cells in (F.lit(BASE_CELLS), BASE_CELLS + FIRST_RETRY * size, BASE_CELLS + SECOND_RETRY * size):
        placed = still.repartition(_tasks(digests), "pid")
        # A pair without an outcome has nothing left after subtraction.
        differ = F.coalesce(F.col("outcome"), F.lit(0))
        tried = placed.join(_differences(placed, cells), "pid", "left").withColumn("differ", F.when(differ >= 0, differ))
        is_open = F.col("differ").isNull()
        tried = stage_compressed(
            tried.select("pid", "differ", size.alias("size"), F.when(is_open, F.col("plus")).alias("plus"),
                         F.when(is_open, F.col("minus")).alias("minus")),
            "peeled",
        )
        parts.append(tried.filter("differ is not null").select("pid", "differ", "size"))
        still = tried.filter("differ is null").select("pid", "plus", "minus")
        digests = tried.agg(F.coalesce(F.sum(F.when(is_open, F.col("size"))), F.lit(0))).first()[0]
    done = still.select("pid", by_digest.cast("bigint").alias("differ"), size.alias("size"))
    for part in parts:
        done = done.unionByName(part)
    shared = (F.col("size") - F.col("differ")) / (F.col("size") + F.col("differ"))
    return done.select("pid", F.when(F.col("size") == 0, 1.0).otherwise(shared).alias("likeness"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness to that and to the next document."""
    text, edited = F.col("text"), F.col("edited_text")
    rows = stage_compressed(
        with_next_text(docs).withColumn("edited_text", edited_text(text, F.col("next_text"))).select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", F.char_length(text).cast("bigint").alias("n_chars"),
            F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"),
            paragraph_digests(text).alias("own"), paragraph_digests(edited).alias("edited"),
            paragraph_digests(F.col("next_text")).alias("next"),
        ),
        "versions",
    )
    pair = F.array(
        F.struct((F.col("rid") * 2).alias("pid"), F.col("own").alias("plus"), F.col("edited").alias("minus")),
        F.struct((F.col("rid") * 2 + 1).alias("pid"), F.col("own").alias("plus"), F.col("next").alias("minus")),
    )
    held = rows.agg(*[F.coalesce(F.sum(F.size(name)), F.lit(0)) for name in ("own", "edited", "next")]).first()
    alike = likeness(rows.select(F.explode(pair).alias("pair")).select("pair.*"), 2 * held[0] + held[1] + held[2])
    near = alike.groupBy(F.floor(F.col("pid") / 2).alias("rid")).agg(
        F.max(F.when(F.col("pid") % 2 == 0, F.col("likeness"))).alias("near_edited"),
        F.max(F.when(F.col("pid") % 2 == 1, F.col("likeness"))).alias("near_next"),
    )
    texts = fingerprints(rows, ["own", "edited"], held[0] + held[1]).select(
        "rid", F.col("own").alias("fingerprint"), F.col("edited").alias("edited_fingerprint")
    )
    return (
        rows.select("rid", "doc_id", "n_chars", "edited_sha256").join(texts, "rid", "left").join(near, "rid")
        .select("doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
                F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"), "near_edited", "near_next")
    )
