"""Near-duplicate documents by a chosen-path similarity join over five-word shingles.

Documents with equal shingle sets are one class. Each class walks down independent trees: at a node, one or two of its
minwise tokens are chosen by the node's hash, and it goes to the children they name. Similar sets choose the
same child often, others rarely. Nodes small enough are compared exhaustively on the tokens; what looks
alike is then confirmed on the full sets, again in bounded groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, components, documents, likely, parted, small_batches, whole_row
from skein.llm.wordhash import buffers, mix, spans, split, text_slices


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending by text and hash, and where each text's begin."""
    w = split(texts, lower=True)
    n = np.diff(w.first)
    doc = np.repeat(np.arange(len(n)), n)
    parts = []
    if len(w.hashes) >= size:
        whole = np.arange(len(w.hashes) - size + 1) + size <= w.first[1:][doc[: len(w.hashes) - size + 1]]
        parts.append((doc[: len(whole)][whole], spans(w.hashes, size, 31)[whole]))
    for k in np.flatnonzero((n > 0) & (n < size)):
        parts.append((np.array([k]), spans(w.hashes[w.first[k] : w.first[k + 1]], int(n[k]), 31) + np.uint64(n[k])))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    doc, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    return h[keep], np.searchsorted(doc[keep], np.arange(len(n) + 1))


def minwise(h: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """``count`` minwise tokens (32 bits) of each set; empty sets get zeros."""
    n, full = len(first) - 1, np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((n, count), np.int32)
    odd = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
    if len(full):
        with np.errstate(over="ignore"):
            for k in range(count):
                low = np.minimum.reduceat(h * odd[k], first[full])
                out[full, k] = (mix(low) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key``, cut so that each holds all rows of its keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b[key].to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], "left")) if k[0] != k[-1] else 0
        if held and (cut or held[-1][key][-1].as_py() != k[0]):
            same = int(np.searchsorted(k, k[0], "right")) if held[-1][key][-1].as_py() == k[0] else 0
            yield pa.Table.from_batches([*held, b.slice(0, max(cut, same) if cut else 0)])
            held = [b.slice(max(cut, same) if cut else 0)]
        elif cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def spread_low(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric boolean matrix reaches."""
    n = len(linked)
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == low).all():
            return low
        low = new


def alike(tokens: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of rows agree in at least ``least`` tokens."""
    n = len(tokens)
    out = np.zeros((n, n), bool)
    step = max(1, 2_000_000 // max(1, tokens.size))
    for i in range(0, n, step):
        out[i : i + step] = (tokens[i : i + step, None, :] == tokens[None, :, :]).sum(2) >= least
    return out


def overlaps(h: np.ndarray, first: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(first) - 1
    of = np.repeat(np.arange(n), np.diff(first))
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[column]
    of, column = of[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((n, n), np.float64)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [c, c + width])
        m = np.zeros((n, width), np.float32)
        m[of[a:b], column[a:b] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def near_duplicates(
    scratch: Scratch,
    docs: DataFrame,
    percent: int = 85,
    size: int = 5,
    tokens: int = 128,
    trees: int = 10,
    depth: int = 8,
    stay: float = 0.7,
    small: int = 400,
    slice_bytes: int = 2_000_000,
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are kept off): n_shingles, component_id, kept, first.

    Two rows are linked if 100 * intersection >= percent * union of their sets of distinct ``size``-word shingles; a text
    of fewer words is one shingle; texts without words are linked with nothing. component_id is the smallest
    doc_id of a component (null for rows without doc_id that are linked with none that has one), kept says that doc_id is
    that one, and ``first`` marks one row a component even where rows repeat. Links found are exact; a link at the
    limit is missed with a chance below 1e-3 for ten trees, and below 1e-7 in nodes that need not branch.

    Nodes branch until they hold ``small`` rows, or ``stay`` of their parent's rows, as near copies do, or for ``depth`` levels; rows
    that share half their tokens hardly stay together so long. A node still larger then, and a larger group to confirm, is dealt into blocks that
    share a few rows, so its work grows with its rows; those whose rows are then not yet in one component with most of the node or
    group meet all its other rows in later blocks.
    """
    spark = scratch.spark
    small_batches(spark)
    docs = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffers(batch["text"])
            for i, j in text_slices(offsets, slice_bytes):
                part = batch.slice(i, j - i)
                h, first = shingle_sets(part["text"], size)
                n, full = np.diff(first), np.diff(first) > 0
                f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if full.any():
                    with np.errstate(over="ignore"):
                        f1[full] = np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), first[:-1][full])
                        f2[full] = np.add.reduceat(mix(h + np.uint64(0x1B873593)), first[:-1][full])
                tok = minwise(h, first, tokens)
                at = pa.array(np.arange(len(n) + 1) * tokens, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["th"], pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(at, pa.array(tok.ravel()))],
                    names=["doc_id", "th", "n", "f1", "f2", "tok"],
                )

    a = docs.mapInArrow(first_pass, f"doc_id {kind}, th long, n long, f1 long, f2 long, tok array<int>")
    a = scratch.keep(a.withColumn("uid", F.monotonically_increasing_id()))
    repeated = not a.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    same = ["n", "f1", "f2"]
    # Of each class of equal sets, the row with the smallest doc_id stands for it.
    classes = a.where("n > 0").groupBy(*same).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid"))["uid"].alias("rep"))
    classes = scratch.keep(classes)
    reps = scratch.keep(a.join(classes.select(F.col("rep").alias("uid")), "uid").select("uid", "doc_id", "th", "tok"))
    a, with_tokens = scratch.keep(a.drop("tok")), a
    scratch.drop(with_tokens)

    def children(df: DataFrame, seed) -> DataFrame:
        """The children of each row's node: one chosen token, and in 18 of 100 nodes a second one."""
        pick = [F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(tokens)).cast("int") for k in (0, 1)]
        child = [F.xxhash64(seed, p, F.get("tok", p)) for p in pick]
        two = F.pmod(F.xxhash64(seed, F.lit(2)), F.lit(100)) < 18
        return df.select("uid", "up", F.explode(F.when(two & (pick[0] != pick[1]), F.array(*child)).otherwise(F.array(child[0]))).alias("node"))

    def dealt(of: DataFrame) -> DataFrame:
        """Rows (uid, grp, n) of groups as (uid, grp, task): larger ones in blocks that share a few rows."""
        blocks = F.ceil(F.col("n") / (small - 20)).cast("int")
        shared = F.pmod(F.xxhash64("uid", "grp", F.lit(3)), F.col("n")) < 16
        own = F.array(F.pmod(F.xxhash64("uid", "grp", F.lit(5)), blocks).cast("int"))
        block = F.when(F.col("n") <= small, F.array(F.lit(0))).when(shared, F.sequence(F.lit(0), blocks - 1)).otherwise(own)
        return of.select("uid", "grp", F.explode(block).alias("b")).select("uid", "grp", F.xxhash64("grp", "b").alias("task"))

    def still_apart(of: DataFrame, comp: DataFrame) -> DataFrame | None:
        """For groups of rows (uid, grp, n) larger than ``small``: tasks (uid, task) in which the rows outside a group's largest
        component meet all others of the group; None if there are none."""
        have = of.join(comp.select(F.col("id").alias("uid"), "component"), "uid", "left")
        have = scratch.keep(have.withColumn("component", F.coalesce("component", "uid")))
        most = have.groupBy("grp", "component").agg(F.count("*").alias("m")).groupBy("grp").agg(F.max(F.struct("m", "component"))["component"].alias("main"))
        have = scratch.keep(have.join(scratch.keep(most), "grp"))
        rest = have.where("component <> main")
        if rest.isEmpty():
            return None
        half = small // 2
        left = scratch.keep(rest.groupBy("grp").agg(F.ceil(F.count("*") / half).cast("int").alias("rb")))
        have = have.join(left, "grp").withColumn("bb", F.ceil(F.col("n") / half).cast("int"))
        mine = F.pmod(F.xxhash64("uid", F.lit(7)), F.col("bb")).cast("int")
        ours = F.pmod(F.xxhash64("uid", F.lit(9)), F.col("rb")).cast("int")
        others = have.select("uid", "grp", mine.alias("b"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"))
        again = have.where("component <> main").select("uid", "grp", F.explode(F.sequence(F.lit(0), F.col("bb") - 1)).alias("b"), ours.alias("r"))
        return others.unionByName(again).select("uid", F.xxhash64("grp", "b", "r", F.lit(1)).alias("task")).distinct()

    roots = reps.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).withColumn("up", F.lit(1 << 60))
    rows = children(roots, F.xxhash64(F.lit(977), F.col("tree")))
    ready, used, last = None, [], None
    for level in range(1, depth + 1):
        rows = scratch.keep(rows)
        # Nodes of the same rows, as most are in the several trees, are one.
        found = rows.groupBy("node").agg(
            F.count("*").alias("n"), F.max("up").alias("up"), F.min("uid").alias("low"), F.max("uid").alias("high"), F.sum(F.xxhash64("uid").cast("decimal(20,0)")).alias("all")
        )
        found = found.where("low <> high")
        found = found.groupBy("n", "low", "high", "all").agg(F.min("node").alias("node"), F.max("up").alias("up"))
        # A node that kept most of its parent's rows holds near copies: to branch again would not part them.
        stays = (F.col("n") >= F.col("up") * stay) | F.lit(level == depth)
        found = scratch.keep(found.select("node", "n", F.when(F.col("n") <= small, "small").when(stays, "last").otherwise("branch").alias("kind")))
        used += [rows, found]
        rows = rows.drop("up").join(found, "node")
        ends = scratch.keep(rows.where("kind = 'last'").select("uid", F.col("node").alias("grp"), "n"))
        used.append(ends)
        last = ends if last is None else last.unionByName(ends)
        done = rows.where("kind = 'small'").select("node", "uid").unionByName(dealt(ends).select(F.col("task").alias("node"), "uid"))
        ready = done if ready is None else ready.unionByName(done)
        if found.where("kind = 'branch'").isEmpty():
            break
        branch = rows.where("kind = 'branch'").withColumnRenamed("n", "up").join(reps.select("uid", "tok"), "uid")
        rows = children(branch, F.xxhash64(F.col("node"), F.lit(level)))

    least = int(tokens * (percent / 100 - 4 * (percent * (100 - percent) / tokens) ** 0.5 / 100))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "node"):
            t = t.combine_chunks()
            node, uid = t["node"].to_numpy(), t["uid"].to_numpy()
            tok = t["tok"].combine_chunks().flatten().to_numpy().reshape(-1, tokens)
            edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            length = np.diff(edge)
            two = edge[:-1][length == 2]
            ok = (tok[two] == tok[two + 1]).sum(1) >= least
            u, v = [uid[two[ok]]], [uid[two[ok] + 1]]
            for k in np.flatnonzero(length > 2):
                s = slice(edge[k], edge[k + 1])
                low = spread_low(alike(tok[s], least))
                other = low != np.arange(len(low))
                u.append(uid[s][other])
                v.append(uid[s][low[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def compared(nodes: DataFrame) -> DataFrame:
        near = nodes.join(reps.select("uid", "tok"), "uid").repartition("node").sortWithinPartitions("node")
        return scratch.keep(near.mapInArrow(compare, "u long, v long").distinct())

    near = compared(ready)
    if not last.isEmpty():
        tasks = still_apart(last, scratch.keep(components(scratch, near)))
        if tasks is not None:
            near = near.unionByName(compared(tasks.withColumnRenamed("task", "node")))
    ids = scratch.keep(reps.select("uid", "doc_id", "th"))
    scratch.drop(reps, *used)
    del rows, found, ready, done, ends, last, used
    scratch.free()
    groups = scratch.keep(components(scratch, near).select(F.col("id").alias("uid"), F.col("component").alias("grp")))
    sizes = scratch.keep(groups.groupBy("grp").agg(F.count("*").alias("n")))

    large_groups = scratch.keep(sizes.where(F.col("n") > small).select("grp", F.lit(True).alias("large")))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each task's rows on their full sets: each row with the smallest it reaches there."""
        for t in whole_runs(batches, "task"):
            t = t.combine_chunks()
            task, uid = t["task"].to_numpy(), t["uid"].to_numpy()
            edge = np.flatnonzero(np.r_[True, task[1:] != task[:-1], True])
            texts = t["text"].combine_chunks()
            group, g = t["grp"].to_numpy(), [np.zeros(0, np.int64)]
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                h, first = shingle_sets(texts.slice(i, j - i), size)
                n = np.diff(first)
                both = overlaps(h, first)
                linked = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (both > 0)
                low = spread_low(linked)
                other = low != np.arange(len(low))
                u.append(uid[i:j][other])
                v.append(uid[i:j][low[other]])
                g.append(group[i:j][other])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, g)], names=["u", "v", "grp"])

    def confirmed(tasks: DataFrame) -> DataFrame:
        wanted = tasks.join(ids, "uid")
        one = likely(docs, "th", wanted)
        one = one.groupBy("doc_id", "th").agg(F.first("text").alias("text")) if repeated else one
        texts = one.join(wanted, one.doc_id.eqNullSafe(wanted.doc_id) & one.th.eqNullSafe(wanted.th)).select("task", "grp", "uid", "text")
        out = texts.repartition("task").sortWithinPartitions("task", "uid").mapInArrow(confirm, "u long, v long, grp long")
        out = scratch.keep(out)
        return out.join(large_groups, "grp", "left").select("u", "v", F.col("large").isNotNull().alias("large"))

    of = groups.join(sizes, "grp")
    links = confirmed(dealt(of))
    # A group within one task is settled: its links are stars around its smallest row.
    big = of.where(F.col("n") > small)
    stars = links.where("not large").select(F.col("u").alias("id"), F.col("v").alias("component"))
    comp = stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
    if not sizes.where(F.col("n") > small).isEmpty():
        links = links.where("large").select("u", "v")
        comp_big = scratch.keep(components(scratch, links))
        tasks = still_apart(big, comp_big)
        if tasks is not None:
            comp_big = components(scratch, links.unionByName(confirmed(tasks.withColumn("grp", F.lit(-1).cast("long"))).select("u", "v")))
        comp = comp.unionByName(comp_big)
    comp = scratch.keep(comp)
    member = a.select("uid", "doc_id", "th", "n", "f1", "f2").join(classes, same, "left")
    member = member.select("uid", "doc_id", "th", "n", F.coalesce("rep", "uid").alias("rep"))
    member = member.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    member = scratch.keep(member.select("uid", "doc_id", "th", F.col("n").alias("n_shingles"), "component"))
    low = scratch.keep(member.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("low")))
    out = member.join(low, "component")
    return out.select(
        "doc_id", "n_shingles", F.col("low.doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("low.doc_id")).alias("kept"),
        (F.col("uid") == F.col("low.uid")).alias("first"), "th",
    )


def one_of_each(scratch: Scratch, docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stand first in their component, with all their columns, whatever their names; of repeated rows one."""
    work = Scratch(scratch.spark)
    found = near_duplicates(work, docs, **settings).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t"))
    odd = found.agg(F.max("first").alias("first"), F.count("*").alias("n")).where("n > 1 or not first")
    odd = scratch.keep(odd.withColumn("h", F.xxhash64("d", "t")))
    work.clear()
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    # Only what may go, or stands twice, is shuffled.
    maybe, others = parted(rows.withColumn("h", F.xxhash64("d", "t")), "h", odd)
    o = odd.select(F.col("d").alias("od"), F.col("t").alias("ot"), "first", "n")
    maybe = maybe.join(o, F.col("d").eqNullSafe(F.col("od")) & (F.col("t") == F.col("ot")), "left").where("first is null or first")
    if not odd.where("n > 1 and first").isEmpty():
        twice = maybe.where("n > 1").withColumn("k", F.expr("row_number() over (partition by d, t order by h)")).where("k = 1")
        maybe = maybe.where("n is null or n = 1").unionByName(twice.drop("k"))
    return others.select("row.*").unionByName(maybe.select("row.*"))


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    out = near_duplicates(Scratch(spark), documents(spark, sf_dir))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op7_chosen_path": op7_chosen_path}
