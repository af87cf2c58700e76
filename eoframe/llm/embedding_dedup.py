"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors cosine >= c means a squared distance of at most 2 - 2c. A rotation keeps
distances and spreads a vector's energy evenly; the rotated vectors are cut into blocks
of a few dimensions, each with its share of the squared distance in proportion to its
dimensions. A pair within the whole budget is within its share in at least one block, so:

1. equal vectors of a label become one with a multiplicity;
2. in every block the vectors of a label are laid on a grid over the block's first two
   coordinates, with cells as wide as the block's share allows, and packed into tiles of
   at most TILE vectors (a crowded cell is cut into as many tiles as it needs);
3. tiles of the same or neighbouring cells meet; in the block, pairs within its share are
   candidates; a candidate that an earlier block finds too is left to that block, so that
   every pair counts once; the rest is verified by the whole cosine;
4. a pair of tiles reports, per vector, the number of its links and the least vector it
   is connected to there: rows in proportion to the vectors, not to the links.

Vectors that are null, empty, zero or hold null or non-finite components, and those with
a null label, link with nothing. Vectors of different lengths are never compared.
Repeated rows are separate vectors (equal ids too); an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .components import connected_components
from .registry import register

COSINE = 0.93
BLOCKS = 8
TILE = 256

_SLACK = 1e-9  # shares are a little wider than needed, so rounding loses nothing


def blocks_of(dim: int) -> list[tuple[int, int]]:
    """Ranges of rotated dimensions: BLOCKS of them, fewer for short vectors."""
    cuts = np.linspace(0, dim, max(1, min(BLOCKS, dim // 2)) + 1).round().astype(int)
    return [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def shares(dim: int, cosine: float) -> np.ndarray:
    return np.array([(2 - 2 * cosine) * (b - a) / dim for a, b in blocks_of(dim)]) * (1 + _SLACK) + _SLACK


def _cells(vectors: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, block, i, j, v, copies, x): every vector in its cell of every block; x
    is the rotated unit vector."""
    def run(batches):
        import pyarrow as pa

        turned = {}
        for b in batches:
            v, copies = b.column(0).to_numpy(), b.column(1).to_numpy()
            vec = b.column(3)
            sizes = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False).astype(float)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = flat[ends[rows][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                if dim not in turned:
                    turned[dim] = (rotation(int(dim)), np.sqrt(shares(int(dim), cosine)))
                turn, width = turned[dim]
                x = x @ turn
                raw = x.tobytes()
                wide = int(dim) * 8
                packed = pa.array([raw[k * wide:(k + 1) * wide] for k in range(len(rows))], pa.binary())
                label = b.column(2).take(pa.array(rows))
                for block, (lo, hi) in enumerate(blocks_of(int(dim))):
                    i = np.floor(x[:, lo] / width[block]).astype(np.int32)
                    j = np.floor(x[:, min(lo + 1, hi - 1)] / width[block]).astype(np.int32)
                    same = np.full(len(rows), 1, np.int32)
                    yield pa.RecordBatch.from_arrays([
                        label, pa.array(same * np.int32(dim)), pa.array(same * np.int32(block)), pa.array(i), pa.array(j),
                        pa.array(v[rows]), pa.array(copies[rows]), packed], ["label", "dim", "block", "i", "j", "v", "copies", "x"])
    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("v", "copies", "label", "vec").mapInArrow(
        run, f"label {kind}, dim int, block int, i int, j int, v bigint, copies bigint, x binary")


def _tiles(cells: DataFrame) -> DataFrame:
    """(label, dim, block, i, j, tile, vs, copies, xs): at most about TILE vectors a row."""
    key = ["label", "dim", "block", "i", "j"]
    counts = cells.groupBy(*key).agg(F.count("*").alias("rows"))
    cut = (cells.join(counts, key)
           .withColumn("tile", F.pmod(F.xxhash64("v"), F.ceil(F.col("rows") / TILE)).cast("int")))
    return (cut.groupBy(*key, "tile").agg(F.collect_list(F.struct("v", "copies", "x")).alias("of"))
            .select(*key, "tile", F.col("of.v").alias("vs"), F.col("of.copies").alias("copies"),
                    F.expr("aggregate(of.x, X'', (a, x) -> concat(a, x))").alias("xs")))


def _linked(one, two, dim: int, block: int, cosine: float, same: bool):
    """Links of two tiles that this block owns, as a boolean matrix."""
    ranges, share = blocks_of(dim), shares(dim, cosine)

    def near(k, x, y):
        lo, hi = ranges[k]
        p, q = x[:, lo:hi], y[:, lo:hi]
        d = (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (p @ q.T)
        return d <= share[k] + 1e-12

    ok = near(block, one, two)
    if same:
        ok = np.triu(ok, 1)
    a, b = np.nonzero(ok)
    if not len(a):
        return None
    hit = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 14):  # bounded memory; the same sums wherever a pair is met
        x, y = one[a[s:s + (1 << 14)]], two[b[s:s + (1 << 14)]]
        gap = (x - y) ** 2
        own = gap[:, slice(*ranges[block])].sum(1) <= share[block]
        for k in range(block):
            own &= gap[:, slice(*ranges[k])].sum(1) > share[k]
        hit[s:s + (1 << 14)] = own & ((x * y).sum(1) >= cosine)
    out = np.zeros(ok.shape, bool)
    out[a[hit], b[hit]] = True
    return out


def _least(adj: np.ndarray, va: np.ndarray, vb: np.ndarray):
    """Per row and column, the least vector it is connected to in the two tiles."""
    big = np.iinfo(np.int64).max
    la, lb = np.where(adj.any(1), va, big), np.where(adj.any(0), vb, big)
    while True:
        na = np.minimum(la, np.where(adj, lb[None], big).min(1))
        nb = np.minimum(lb, np.where(adj, na[:, None], big).min(0))
        if (na == la).all() and (nb == lb).all():
            return na, nb
        la, lb = na, nb


def _links(tiles: DataFrame, cosine: float) -> DataFrame:
    """(v, links, least): partial results of every pair of tiles that meet."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, links, least = [], [], []
            for r in b.to_pylist():
                one, two = (np.frombuffer(r[f"xs_{s}"]).reshape(-1, r["dim"]) for s in "ab")
                va, vb = (np.array(r[f"vs_{s}"], np.int64) for s in "ab")
                ca, cb = (np.array(r[f"copies_{s}"], np.int64) for s in "ab")
                adj = _linked(one, two, r["dim"], r["block"], cosine, r["same"])
                if adj is None or not adj.any():
                    continue
                na, nb = _least(adj | adj.T, va, vb) if r["same"] else _least(adj, va, vb)
                for v, n, low in ((va, adj @ cb, na), (vb, ca @ adj, nb)):
                    at = np.flatnonzero(n)
                    ids.append(v[at])
                    links.append(n[at])
                    least.append(low[at])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (ids, links, least)],
                                                 ["v", "links", "least"])

    own = ["tile", "vs", "copies", "xs"]
    a = tiles.select("label", "dim", "block", *[F.col(c).alias(f"{c}_a") for c in own], "i", "j",
                     F.explode(F.expr("array(struct(0 AS di, 0 AS dj), struct(0 AS di, 1 AS dj), struct(1 AS di, -1 AS dj), "
                                      "struct(1 AS di, 0 AS dj), struct(1 AS di, 1 AS dj))")).alias("o"))
    a = a.withColumns({"i": F.col("i") + F.col("o.di"), "j": F.col("j") + F.col("o.dj"),
                       "here": (F.col("o.di") == 0) & (F.col("o.dj") == 0)}).drop("o")
    b = tiles.select("label", "dim", "block", "i", "j", *[F.col(c).alias(f"{c}_b") for c in own])
    both = a.join(b, ["label", "dim", "block", "i", "j"]).where(~F.col("here") | (F.col("tile_a") <= F.col("tile_b")))
    both = both.withColumn("same", F.col("here") & (F.col("tile_a") == F.col("tile_b")))
    return both.drop("label", "i", "j", "here", "tile_a", "tile_b").mapInArrow(run, "v bigint, links bigint, least bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of vectors. Ids are integers."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                          F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    fine = F.expr("label IS NOT NULL AND vec IS NOT NULL AND exists(vec, x -> x <> 0) AND "
                  "forall(vec, x -> coalesce(abs(x) < double('Infinity'), false))")
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    # Equal vectors of a label are one vertex, known by its least id.
    classes = materialise(rows.where("fine").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                          .withColumn("v", F.xxhash64("label", "vec")))
    if classes.groupBy("v").count().where("count > 1").limit(1).count():
        raise RuntimeError("two different vectors have one 64-bit hash")
    tiles = materialise(_tiles(_cells(classes, cosine)))
    found = materialise(_links(tiles, cosine).groupBy("v", "least").agg(F.sum("links").alias("links")))
    labels = connected_components(found.select(F.col("v").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    whole = (classes.select("v", "label", "vec", "rep", "copies").join(links, "v", "left").join(labels, "v", "left")
             .withColumn("component", F.coalesce("component", "v")))
    least = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    whole = whole.join(least, "component").select(
        "label", "vec", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(whole.withColumn("fine", F.lit(True)), ["label", "vec", "fine"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id") == component).alias("kept"))


ORACLE = f"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
reach AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings
  UNION
  SELECT reach.v, links.b FROM reach JOIN links ON links.a = reach.r),
comp AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON v = vec_id LEFT JOIN n ON a = vec_id
"""


@register("op6_embedding_dedup", ORACLE)
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
