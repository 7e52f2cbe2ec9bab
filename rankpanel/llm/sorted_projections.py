"""Near-duplicate vectors by sorted projection passes.

In each pass a vector gets a key of ``BITS`` random hyperplane signs,
concatenated. Vectors of one group (equal label and length) are ordered
lexicographically by that key and cut into blocks of about ``BLOCK`` neighbours; a
vector is compared with those of its own block and of the next one.
Where the farthest compared blocks still hold links, the window doubles until
they do not, so that dense runs of near copies are compared to their end: no
partner is capped. Verified pairs are united across passes; a pair compared in
several passes counts in the first one only, which follows from the block
numbers of its vectors, so pairs are never written out.

Cosine is computed in double precision and links have cosine >= ``least``. Equal
vectors are one class first, so copies cost nothing.

Rows: one per input row. Vectors that are null, empty, zero, or hold null or
non-finite components, and vectors without a label, link with nothing; repeated
rows are copies of each other; null or repeated ids are told apart by a row
number; ties keep the smallest id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankpanel.llm.components import components
from rankpanel.llm.tables import arrow_rows, row_key, ship_package
from rankpanel.session import materialize, shuffle_partitions

LEAST = 0.93
PASSES, BITS, BLOCK = 12, 63, 384
#: Block pairs in one Arrow batch.
BATCH = 32
#: Rows per range partition of one pass.
PARTITION_ROWS = 1 << 18


def usable(vector: str) -> str:
    """SQL for a vector that can have a cosine."""
    return (
        f"coalesce(size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        f" and exists({vector}, x -> x != 0), false)"
    )


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _keys(passes: int, bits: int):
    """Per vector and pass: the key whose order is that of the concatenated signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            vectors = _vectors(batch.column(3))
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([5, int(dim)]).standard_normal((int(dim), passes * bits))
                at = np.flatnonzero(dims == dim)
                raw = np.stack([vectors[i] for i in at])
                x = raw.astype(np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                signs = ((x @ planes[dim]) > 0).reshape(len(at), passes, bits)
                keys = (signs * weight).sum(axis=2, dtype=np.int64)
                part, blobs = batch.take(pa.array(at)), pa.array([r.tobytes() for r in raw], pa.binary())
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(at), p, dtype=np.int32)), part.column(2), pa.array(np.full(len(at), dim, dtype=np.int32)),
                            pa.array(keys[:, p]), part.column(0), part.column(1), blobs,
                        ],
                        ["pass", "label", "dim", "key", "rep", "copies", "vector"],
                    )

    return run


def _blocks(size: int):
    """Cut a sorted partition into blocks of one group each, of half to one and a half times ``size`` where there are enough rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        group, number = None, 0

        def flush(n: int) -> pa.RecordBatch:
            nonlocal number, held
            now, held = held[:n], held[n:]
            row = {"part": part, "number": number, "pass": group[0], "label": group[1], "dim": group[2]}
            row |= {"reps": [h[0] for h in now], "copies": [h[1] for h in now], "vectors": b"".join(h[2] for h in now)}
            number += 1
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6)]
            for p, label, dim, rep, copies, vector in zip(*cols):
                if held and group != (p, label, dim):
                    yield flush(len(held))
                group = (p, label, dim)
                held.append((rep, copies, vector))
                if len(held) >= size + size // 2:
                    yield flush(size)
        if held:
            yield flush(len(held))

    return run


_BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("number", pa.int32()), ("pass", pa.int32()), ("label", pa.string()), ("dim", pa.int32()),
    ("reps", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("vectors", pa.binary()),
])
_BLOCK_SQL = "part int, number int, pass int, label string, dim int, reps array<long>, copies array<long>, vectors binary"


def _unit(blob: bytes, dim: int, wide: bool) -> np.ndarray:
    x = np.frombuffer(blob, np.float64 if wide else np.float32).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(left: bytes, right: bytes, dim: int, wide: bool, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked vectors of two blocks, or of one block above the diagonal."""
    cosine = _unit(left, dim, wide) @ _unit(right, dim, wide).T
    i, j = np.nonzero(cosine >= least)
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def _touching(wide: bool, least: float):
    """Block pairs (block, ahead) that hold a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, ahead, dim, x, y = (batch.column(k).to_pylist() for k in range(5))
            hit = [len(_linked(a, b or a, d, wide, o == 0, least)[0]) > 0 for o, d, a, b in zip(ahead, dim, x, y)]
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["block", "ahead"])

    return run


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked node to the least node of its component inside this block pair."""
    ids, flat = np.unique(np.concatenate([nodes[i], nodes[j]]), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    off = root != np.arange(len(ids))
    return ids[off], ids[root[off]]


def _counted(wide: bool, least: float):
    """Links of a block pair that no earlier pass compared: weights per vector and forest edges.

    ``pa`` and ``pb`` hold, per vector, its block in each pass and then how far that block was compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}

            def longs(name: str, r: int) -> np.ndarray:
                return col[name][r].values.to_numpy()

            def places(name: str, r: int) -> tuple[np.ndarray, np.ndarray]:
                flat = np.frombuffer(b"".join(col[name][r].as_py()), dtype=">i4").astype(np.int64)
                both = flat.reshape(len(col[name][r]), -1)
                return both[:, : both.shape[1] // 2], both[:, both.shape[1] // 2 :]

            for r in range(batch.num_rows):
                ahead, dim, turn = col["ahead"][r].as_py(), col["dim"][r].as_py(), col["pass"][r].as_py()
                a, b = ("x", "ra", "ca", "pa"), ("y", "rb", "cb", "pb") if ahead else ("x", "ra", "ca", "pa")
                i, j = _linked(col[a[0]][r].as_py(), col[b[0]][r].as_py(), dim, wide, ahead == 0, least)
                if not len(i):
                    continue
                (sa, ea), (sb, eb) = places(a[3], r), places(b[3], r)
                fresh = np.ones(len(i), dtype=bool)
                for q in range(turn):
                    s, t = sa[i, q], sb[j, q]
                    fresh &= np.abs(s - t) > np.where(s <= t, ea[i, q], eb[j, q])
                i, j = i[fresh], j[fresh]
                if not len(i):
                    continue
                ra, rb, ca, cb = longs(a[1], r), longs(b[1], r), longs(a[2], r), longs(b[2], r)
                u, v = _forest(np.concatenate([ra, rb]), i, j + len(ra))
                degree_a = np.bincount(i, weights=cb[j], minlength=len(ra)).astype(np.int64)
                degree_b = np.bincount(j, weights=ca[i], minlength=len(rb)).astype(np.int64)
                rep = np.concatenate([ra[degree_a > 0], rb[degree_b > 0], u])
                weight = np.concatenate([degree_a[degree_a > 0], degree_b[degree_b > 0], np.zeros(len(u), np.int64)])
                edge = np.concatenate([np.full(len(rep) - len(u), -1, np.int64), v])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep), pa.array(weight), pa.array(edge, mask=np.arange(len(edge)) < len(edge) - len(v))], ["rep", "weight", "other"]
                )

    return run


def _numbered(blocks: DataFrame) -> DataFrame:
    """Blocks numbered in order; the window runs over one row per partition."""
    last = blocks.groupBy("part").agg((F.max("number") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = last.select(F.col("part").alias("_part"), before.cast("long").alias("_start"))
    return blocks.join(F.broadcast(start), F.col("part") == F.col("_part")).withColumn("block", F.col("_start") + F.col("number")).drop("_start", "_part", "number", "part")


def _compared(blocks: DataFrame, spans: DataFrame, own: dict[str, str], with_self: bool) -> DataFrame:
    """Block pairs for rows (block, ahead), within one pass and group; a block with itself (ahead 0) needs no join.

    ``own`` names the columns of the first block and, for the second one, what they become.
    """
    shared = ["block", "dim", "pass"]
    other = blocks.select(*[F.col(c).alias(f"_{c}") for c in ("block", "pass", "label", "dim")], *[F.col(c).alias(n) for c, n in own.values()])
    pairs = spans.select(F.col("block").alias("_at"), "ahead").join(blocks, F.col("_at") == F.col("block"))
    same = (F.col("pass") == F.col("_pass")) & (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    first = [F.col(c).alias(n) for n, (c, _) in own.items()]
    out = pairs.join(other, (F.col("block") + F.col("ahead") == F.col("_block")) & same).select(*shared, "ahead", *first, *[n for _, n in own.values()])
    if not with_self:
        return out
    alone = blocks.select(*shared, F.lit(0).alias("ahead"), *first)
    return out.unionByName(alone, allowMissingColumns=True)


def near_links(classes: DataFrame, wide: bool, least: float = LEAST, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(rep, links to members of other classes) and forest edges (a, b) over classes (rep, copies, label, vector)."""
    spark = classes.sparkSession
    rows = classes.count() * passes
    n = max(shuffle_partitions(spark), math.ceil(rows / PARTITION_ROWS))
    order = ["pass", "label", "dim", "key", "rep"]
    keyed = classes.select("rep", "copies", "label", "vector").mapInArrow(
        _keys(passes, BITS), "pass int, label string, dim int, key long, rep long, copies long, vector binary"
    )
    cut = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks(BLOCK), _BLOCK_SQL)
    blocks = materialize(_numbered(materialize(cut, "cut")), "vector-blocks")
    with arrow_rows(spark, BATCH):
        return _block_links(blocks, wide, least)


def _block_links(blocks: DataFrame, wide: bool, least: float) -> tuple[DataFrame, DataFrame]:
    spans = blocks.select("block", F.lit(1).alias("ahead"))
    reach, far = spans, 1
    while True:
        pairs = _compared(blocks, spans, {"x": ("vectors", "y")}, False).select("block", "ahead", "dim", "x", "y")
        hit = materialize(pairs.mapInArrow(_touching(wide, least), "block long, ahead int"), "touching")
        edge = hit.where(F.col("ahead") > far // 2).select("block").distinct()
        if edge.isEmpty():
            break
        spans = edge.select("block", F.explode(F.sequence(F.lit(far + 1), F.lit(2 * far))).alias("ahead"))
        far *= 2
        reach = reach.unionByName(edge.select("block", F.lit(far).alias("ahead")))
    reach = reach.groupBy("block").agg(F.max("ahead").alias("reach"))
    places = blocks.select("block", "pass", F.posexplode("reps").alias("pos", "rep"))
    places = places.join(reach.withColumnRenamed("block", "_b"), F.col("block") == F.col("_b")).drop("_b")
    places = materialize(places, "places")
    seen = places.groupBy(F.col("rep").alias("_rep")).agg(F.sort_array(F.collect_list(F.struct("pass", "block", "reach"))).alias("at"))
    ints = F.concat(F.transform("at.block", lambda x: x.cast("int")), F.col("at.reach"))
    seen = seen.select("_rep", F.unhex(F.array_join(F.transform(ints, lambda x: F.lpad(F.hex(x), 8, "0")), "")).alias("seen"))
    by_block = places.join(seen, F.col("rep") == F.col("_rep")).groupBy(F.col("block").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("pos", "seen"))).alias("p"))
    full = blocks.join(by_block, F.col("block") == F.col("_b")).withColumn("seen", F.col("p.seen")).drop("_b", "p")
    full = materialize(full, "placed-blocks")
    spans = reach.select("block", F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("ahead"))
    own = {"x": ("vectors", "y"), "ra": ("reps", "rb"), "ca": ("copies", "cb"), "pa": ("seen", "pb")}
    counted = materialize(_compared(full, spans, own, True).mapInArrow(_counted(wide, least), "rep long, weight long, other long"), "counted")
    degrees = counted.where("other is null").groupBy("rep").agg(F.sum("weight").alias("links"))
    return degrees, counted.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))


def groups(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, passes: int = PASSES) -> DataFrame:
    """Per row: key, n_links (other vectors linked directly), component_id (smallest key reachable) and kept."""
    ship_package(table.sparkSession)
    table, row = row_key(table, key)
    wide = dict(table.dtypes)[vector] != "array<float>"
    typed = table.select(
        F.col(row).cast("long").alias("row"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>" if wide else "array<float>").alias("vector")
    )
    valid = typed.where(F.expr(f"label is not null and {usable('vector')}"))
    hashed = valid.select("row", "label", "vector", F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2"))
    narrow = hashed.select("row", "label", "h1", "h2")
    classes = materialize(narrow.groupBy("label", "h1", "h2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = classes.select(F.col("rep").alias("_rep"), "copies")
    reps = materialize(typed.join(reps, F.col("row") == F.col("_rep")).select(F.col("row").alias("rep"), "copies", "label", "vector"), "reps")
    degrees, edges = near_links(reps, wide, least, passes)
    roots = components(edges)
    per = classes.join(degrees.withColumnRenamed("rep", "_d"), F.col("rep") == F.col("_d"), "left").join(roots, F.col("rep") == F.col("vertex"), "left")
    per = per.select(
        F.col("label").alias("_l"), F.col("h1").alias("_1"), F.col("h2").alias("_2"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("_root"),
    )
    member = narrow.join(per, (F.col("label") == F.col("_l")) & (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
    member = member.select(F.col("row").alias("_member"), "n_links", "_root")
    out = table.select(F.col(row).alias("_r"), F.col(key).alias("_k")).join(member, F.col("_r") == F.col("_member"), "left")
    out = out.select("_r", "_k", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_root", "_r").alias("_root"))
    kept = (F.col("_r") == F.col("_root")).alias("kept")
    if row == key:
        return out.select(F.col("_k").alias(key), "n_links", F.col("_root").alias("component_id"), kept)
    named = table.select(F.col(row).alias("_named"), F.col(key).alias("component_id"))
    return out.join(named, F.col("_root") == F.col("_named")).select(F.col("_k").alias(key), "n_links", "component_id", kept)


#: ``groups`` over the embeddings as DuckDB SQL: every pair of a label is compared.
ORACLE_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
    reach AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
    c AS (SELECT x, min(y) AS least FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(least, vec_id), vec_id) AS component_id, coalesce(least(least, vec_id), vec_id) = vec_id AS kept
    FROM v LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id"""
