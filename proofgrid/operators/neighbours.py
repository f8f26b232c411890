"""Near vectors below quadratic work: buckets of random hyperplanes, with the exact comparison of all pairs as their limit.

A table of buckets cuts the sphere by `bits` random hyperplanes; two vectors of cosine t fall on the same side of one with probability
1 - arccos(t) / pi, whatever the data. From that follows how many tables meet a pair at the threshold with the recall asked
for, and what that costs: `plan` takes the cheapest number of bits. None at all (every pair is compared) is among the choices: it is what small
tables and low thresholds come to. Whatever shares a bucket is compared exactly, so buckets lose pairs but never invent one.

A bucket of very many rows is dealt into blocks, and blocks meet in tasks of their own, so copies of one vector are no hot spot.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.functions.columns import l2_similarity
from proofgrid.operators.retrieval import BLOCK, best_of, knn, matrix_of, plain_vectors, similar_pairs, top_k
from proofgrid.session import ship_package
from proofgrid.sinks.storage import staged

#: What sending a row to one more bucket costs, in comparisons, and the most bits of a code.
COPY, BITS = 500, 40
SEED = 41


@dataclass(frozen=True)
class Plan:
    """bits of a code, tables of buckets, further buckets that a query looks into in each table, the share of pairs met at the threshold, and comparisons a row."""

    bits: int
    tables: int
    probes: int
    recall: float
    compared: float


def same_side(cosine: float) -> float:
    """How likely a random hyperplane leaves two vectors on one side."""
    return 1 - float(np.arccos(np.clip(cosine, -1, 1))) / np.pi


@lru_cache(maxsize=4096)
def met(bits: int, probes: int, cosine: float) -> float:
    """How likely one table brings a query to a vector of that cosine, if it also looks into `probes` buckets across its nearest hyperplanes.

    Without probes a power; with them the mean over drawn projections, whose law depends on the cosine alone.
    """
    if not probes or not bits:
        return same_side(cosine) ** bits
    draw = np.random.default_rng(SEED)
    x = draw.normal(size=(4000, bits))
    y = cosine * x + np.sqrt(max(1 - cosine**2, 0)) * draw.normal(size=(4000, bits))
    differ = (x > 0) != (y > 0)
    ranks = np.argsort(np.argsort(np.abs(x), axis=1), axis=1)
    return float(((differ.sum(1) == 0) | ((differ.sum(1) == 1) & ((differ * (ranks < probes)).sum(1) == 1))).mean())


def plan(rows: int, cosine: float, recall: float, probes: int = 0) -> Plan:
    """The cheapest way to meet pairs at the cosine with the recall; 1 and more asks for the exact way."""
    best = Plan(0, 1, 0, 1.0, float(rows))
    cost = rows + COPY
    if recall >= 1:
        return best
    for bits in range(1, BITS + 1):
        p = met(bits, min(probes, bits), round(float(cosine), 4))
        if not 0 < p < 1:
            continue
        tables = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - p))))
        looks = 1 + min(probes, bits)
        compared = tables * looks * rows / 2**bits
        if compared + COPY * tables * looks < cost:
            cost, best = compared + COPY * tables * looks, Plan(bits, tables, min(probes, bits), 1 - (1 - p) ** tables, compared)
    return best


def planes(p: Plan, size: int) -> np.ndarray:
    """The hyperplanes of all tables, the same in every task: a row each, table by table."""
    return np.random.default_rng(SEED).normal(size=(p.tables * p.bits, size))


def codes(matrix: np.ndarray, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each row in each table, and the projections they come from."""
    if not p.bits:
        return np.zeros((len(matrix), 1), np.int64), np.zeros((len(matrix), 1, 0))
    at = (matrix @ planes(p, matrix.shape[1]).T).reshape(len(matrix), p.tables, p.bits)
    return ((at > 0) @ (1 << np.arange(p.bits, dtype=np.int64))).astype(np.int64), at


def looked_into(matrix: np.ndarray, p: Plan) -> np.ndarray:
    """Rows x tables x (1 + probes): the own bucket, then those across the nearest hyperplanes."""
    own, at = codes(matrix, p)
    near = np.argsort(np.abs(at), axis=2)[:, :, : p.probes]
    return np.concatenate([own[:, :, None], own[:, :, None] ^ (np.int64(1) << near)], axis=2)


def in_buckets(rows: DataFrame, p: Plan, side: int, probing: bool) -> DataFrame:
    """side, bucket table, code, id, vector: a copy of each row for every bucket it goes to."""
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = matrix_of(batch.column("vector"))
            found = looked_into(matrix, p) if probing else codes(matrix, p)[0][:, :, None]
            n, tables, looks = found.shape
            at = pa.array(np.repeat(np.arange(n), tables * looks))
            table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), looks), n)
            yield pa.RecordBatch.from_pydict({"side": pa.array(np.full(len(at), side, np.int32)), "bucket": pa.array(table), "code": pa.array(found.reshape(-1)), "id": batch.column("id").take(at), "vector": batch.column("vector").take(at)})

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, f"side int, bucket int, code bigint, id bigint, vector {kind}")


def met_in_buckets(left: DataFrame, right: DataFrame | None, p: Plan, compare, schema: str, block: int = BLOCK, probing: bool = False) -> DataFrame:
    """compare(ids, matrix, ids, matrix, bucket table, same) over all that shares a bucket; without right, left meets itself."""
    one = in_buckets(left, p, 0, probing)
    return met_in_blocks(one if right is None else one.unionByName(in_buckets(right, p, 1, False)), right is None, compare, schema, block)


def met_in_blocks(both: DataFrame, alone: bool, compare, schema: str, block: int = BLOCK) -> DataFrame:
    """compare over all of (side, bucket, code, id, vector) that share bucket and code; alone, side 0 meets itself.

    Rows of buckets with more than `block` rows of a side are dealt into blocks by hash; a block of one side meets each of the other. With a
    column `family`, compare also gets a number for the family of each row of both, the same for equal ones (nulls among them).
    """
    grouped = "family" in both.columns
    kept = ["bucket", "code", "id", "vector", *(["family"] if grouped else [])]
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    sizes = both.groupBy("bucket", "code").agg(*[F.ceil(F.sum((F.col("side") == s).cast("long")) / block).cast("int").alias(f"n{s}") for s in (0, 1)])
    sizes = staged(sizes.where("n0 > 1 OR n1 > 1"), "crowded")
    dealt = both.join(sizes, ["bucket", "code"], "left").withColumns({"n0": F.greatest(F.coalesce("n0", F.lit(1)), F.lit(1)), "n1": F.greatest(F.coalesce("n1", F.lit(1)), F.lit(1))})
    if alone:
        i = part(F.col("n0"))
        dealt = dealt.withColumn("i", i).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n0") - 1)))
        dealt = dealt.select(*kept, F.when(F.col("o") < F.col("i"), 1).otherwise(0).alias("side"), F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"))
    else:
        mine, others = part(F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))), F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1))
        dealt = dealt.withColumn("m", mine).withColumn("o", others).select(*kept, "side", *[F.when(F.col("side") == s, F.col("m")).otherwise(F.col("o")).alias(c) for s, c in ((0, "i"), (1, "j"))])

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        if grouped:
            table = table.set_column(table.column_names.index("family"), "family", pc.fill_null(table.column("family").combine_chunks().dictionary_encode().indices, -1))
        itself = alone and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sides = [table, table] if itself else [table.filter(pc.equal(table.column("side"), s)) for s in (0, 1)]
        if not all(t.num_rows for t in sides):
            return pa.table({c.split()[0]: pa.array([], pa.float64() if c.endswith("double") else pa.int64()) for c in schema.split(", ")})
        (a, x), (b, y) = [(t.column("id").to_numpy(), matrix_of(t.column("vector"))) for t in sides]
        families = [t.column("family").to_numpy() for t in sides] if grouped else []
        return pa.table(compare(a, x, b, y, table.column("bucket")[0].as_py(), itself, *families))

    return dealt.groupBy("bucket", "code", "i", "j").applyInArrow(run, schema)


def near_pairs(vectors: DataFrame, threshold: float, recall: float = 0.95, others: DataFrame | None = None, digits: int = 6, block: int = BLOCK, way: Plan | None = None) -> DataFrame:
    """a, b, cosine of pairs of unit vectors (id, vector) with a cosine of threshold or more, each once: a < b, or a of vectors and b of others if given.

    At least the share `recall` of the pairs at the threshold is met, of closer ones more; recall 1 is the exact way. A pair comes out
    of the first table that it shares a bucket in, so tables need no removal of repeats. Rows without a vector have no pairs.
    """
    left = staged(plain_vectors(vectors), "vectors")
    right = None if others is None else staged(plain_vectors(others), "vectors")
    n = left.count() if right is None else max(left.count(), right.count())
    way, alone = way or plan(n, threshold, recall), right is None
    if not way.bits:
        return similar_pairs(left, threshold, right, block, digits)

    def compare(a, x, b, y, bucket, itself):
        cosines = np.round(x @ y.T, digits)
        p, q = np.nonzero(cosines >= threshold)
        if alone:
            keep = a[p] < b[q] if itself else a[p] != b[q]
            p, q = p[keep], q[keep]
        if way.tables > 1 and len(p):
            used_p, used_q = np.unique(p), np.unique(q)
            first = np.empty(len(p), np.int64)
            of_x, of_y = codes(x[used_p], way)[0], codes(y[used_q], way)[0]
            at_p, at_q = np.searchsorted(used_p, p), np.searchsorted(used_q, q)
            for start in range(0, len(p), 1 << 16):
                part = slice(start, start + (1 << 16))
                first[part] = (of_x[at_p[part]] == of_y[at_q[part]]).argmax(axis=1)
            keep = first == bucket
            p, q = p[keep], q[keep]
        low, high = a[p], b[q]
        if alone:
            low, high = np.minimum(low, high), np.maximum(low, high)
        return {"a": low, "b": high, "cosine": cosines[p, q]}

    return met_in_buckets(left, right, way, compare, "a long, b long, cosine double", block)


def near_pairs_within(vectors: DataFrame, threshold: float, others: DataFrame | None = None, digits: int = 6, block: int = BLOCK) -> DataFrame:
    """near_pairs over (id, vector, family), of one family only and all of them: the exact way.

    Families are dealt by hash into buckets of half a block, whose rows meet in one task, so the work follows the rows, and the square of a family's
    size only where that outgrows a block: its rows then meet block by block. Rows without a family are one.
    """
    alone = others is None
    sides = [staged(df.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), "vector", "family"), "vectors") for df in ([vectors] if alone else [vectors, others])]
    n = max(1, -(-2 * max(df.count() for df in sides) // block))
    ship_package(vectors.sparkSession)
    code = F.pmod(F.xxhash64("family"), F.lit(n)).cast("long")
    both = [df.select(F.lit(side).alias("side"), F.lit(0).alias("bucket"), code.alias("code"), "id", "vector", "family") for side, df in enumerate(sides)]

    def compare(a, x, b, y, bucket, itself, of_a, of_b):
        cosines = np.round(x @ y.T, digits)
        p, q = np.nonzero((cosines >= threshold) & (of_a[:, None] == of_b))
        if alone:
            keep = a[p] < b[q] if itself else a[p] != b[q]
            p, q = p[keep], q[keep]
        low, high = (np.minimum(a[p], b[q]), np.maximum(a[p], b[q])) if alone else (a[p], b[q])
        return {"a": low, "b": high, "cosine": cosines[p, q]}

    return met_in_blocks(both[0] if alone else both[0].unionByName(both[1]), alone, compare, "a long, b long, cosine double", block)


def kth_cosine(queries: DataFrame, vectors: DataFrame, k: int, sample: int = 256, share: float = 0.1) -> float:
    """The cosine that all but a share of the queries' k-th neighbours reach, from exact searches of `sample` queries at most: what a plan has to meet."""
    few = queries.orderBy(F.xxhash64("qid"), "qid").limit(sample)
    last = knn(few, vectors, k).groupBy("qid").agg(F.min("cosine").alias("c"))
    found = last.agg(F.percentile("c", share)).first()[0]
    return 1.0 if found is None else float(found)


def near_neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10, recall: float = 0.95, probes: int = 4, digits: int = 6, block: int = BLOCK, way: Plan | None = None) -> DataFrame:
    """qid, id, cosine, similarity, rank: nearest vectors of many queries (qid, vector) among vectors (id, vector), met in buckets with probes.

    The tables are planned for the cosine that the k-th neighbours of a sample of the queries have. Only queries are sent to further
    buckets; a vector stands once in each table. recall 1 is the exact way.
    """
    rows, asked = staged(plain_vectors(vectors), "vectors"), staged(plain_vectors(queries, "qid"), "queries")
    if way is None and recall >= 1:
        return knn(asked.withColumnRenamed("id", "qid"), rows, k, digits=digits, small=0)
    if way is None:
        way = plan(rows.count(), kth_cosine(asked.withColumnRenamed("id", "qid"), rows, k), recall, probes)

    def compare(a, x, b, y, bucket, itself):
        cosines = np.round(x @ y.T, digits)
        return best_of(a, cosines, b, k)

    hits = met_in_buckets(asked, rows, way, compare, "qid long, id long, cosine double", block, probing=True)
    hits = hits.groupBy("qid", "id").agg(F.max("cosine").alias("cosine"))  # a query may meet a vector in several tables
    return top_k(hits.withColumn("similarity", F.round(l2_similarity(F.col("cosine")), digits)), "cosine", k)
