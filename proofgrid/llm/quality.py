"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of every text are counted once, in Arrow batches, and kept as a narrow table. The features approximate a
Gaussian kernel over the standardised statistics; each partition of labelled rows adds up its share of the normal
equations of its fold, the shares are summed by rows of the matrix across the cluster, and the driver solves systems of fixed
size: one a fold, whose scores of the other fold calibrate, and one of all rows, which scores.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from proofgrid.llm.common import in_arrow, likely_members, materialize

STATISTICS = ("words", "chars_per_word", "distinct", "repeats", "lines", "distinct_lines", "upper", "digits", "symbols", "marks", "breaks", "wide", "entropy", "longest_run")
_BYTES = np.arange(256)
_CLASSES = np.stack(
    [
        (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 48) & (_BYTES <= 57), np.isin(_BYTES, list(b"#$%&*|<>{}[]\\^~@_=+`")), np.isin(_BYTES, list(b"!?.,;:'\"-()/")), _BYTES == 10, _BYTES >= 128,
    ], axis=1,
).astype(float)


def statistics(text: str) -> list[float]:
    """The statistics of one text, by their names above; an empty text has zeros."""
    raw = text.encode("utf-8", "replace")
    words = text.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts[counts > 0] / size
    lines = text.split("\n")
    same = sum(map(operator.eq, words, islice(words, 1, None)))
    return [
        np.log1p(len(words)), np.log1p(len(text) / n), len(set(words)) / n, same / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
        *(counts @ _CLASSES / size), float(-(shares * np.log2(shares)).sum()), np.log1p(max(map(len, words), default=0)),
    ]


def measure_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(-1)
        ends = pa.array(np.arange(batch.num_rows + 1) * len(STATISTICS), pa.int32())
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.ListArray.from_arrays(ends, pa.array(found))], names=[*names, "statistics"])


def columns_of(df: DataFrame, but: str, *more: StructField) -> StructType:
    """The columns of df but one, and more, as a schema."""
    return StructType([*[f for f in df.schema if f.name != but], *more])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the columns to keep and the array of statistics of every row; a null text is empty."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return in_arrow(narrow, measure_in_tasks, columns_of(narrow, "text", StructField("statistics", ArrayType(DoubleType()))))


@dataclass
class Model:
    """Everything a score needs; its size does not depend on the data."""

    center: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, statistics: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.center) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(z), 1))], axis=1)

    def raw(self, statistics: np.ndarray) -> np.ndarray:
        return self.features(statistics) @ self.weights

    def score(self, statistics: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(statistics), self.levels[0])
        return np.clip(np.interp(self.raw(statistics), self.knots, self.levels), 0, 1)


def stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def sum_in_tasks(model: Model) -> Callable:
    """Each partition's share of the normal equations of either fold: row i of Z'Z, followed by Z'y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y, folds = model.features(stacked(batch)), batch.column("label").to_numpy(zero_copy_only=False).astype(float), batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in (0, 1):
                rows = z[folds == fold]
                if len(rows):
                    totals[fold] = totals.get(fold, 0) + rows.T @ np.concatenate([rows, y[folds == fold, None]], axis=1)
        for fold, total in totals.items():
            at = pa.array(range(len(total)), pa.int32())
            yield pa.RecordBatch.from_pydict({"fold": pa.array([fold] * len(total), pa.int32()), "i": at, "sums": pa.array(list(total), pa.list_(pa.float64()))})

    return run


def add_up(table: pa.Table) -> pa.Table:
    shares = np.stack(table.column("sums").to_numpy())
    sums = shares[np.lexsort(shares.T)].sum(axis=0)  # in an order of their own, not of arrival
    return pa.table({"fold": table.column("fold").slice(0, 1).combine_chunks(), "i": table.column("i").slice(0, 1).combine_chunks(), "sums": pa.array([sums], pa.list_(pa.float64()))})


def raw_in_tasks(models: Sequence[Model]) -> Callable:
    """The raw score of each row by the model of the fold that it is not in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, folds = stacked(batch), batch.column("fold").to_numpy(zero_copy_only=False)
            raw = np.where(folds == 0, models[1].raw(found), models[0].raw(found))
            yield pa.RecordBatch.from_pydict({"raw": pa.array(raw, pa.float64()), "label": batch.column("label")})

    return run


def score_in_tasks(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.round(model.score(stacked(batch)), 9) if batch.num_rows else np.array([], float)
            names = [c for c in batch.schema.names if c != "statistics"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(scores, pa.float64())], names=[*names, "score"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over points in ascending x with weights n: (x, non-decreasing levels) of the pools' centres."""
    pools: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b, w in zip(x, y, n):
        pools.append([w, b * w, a * w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(labelled: DataFrame, n_features: int = 128, width: float = 3.0, ridge: float = 1e-3, bins: int = 1024, seed: int = 11) -> Model:
    """Fits to rows (statistics, label 0 or 1, fold 0 or 1), all of them; what reaches the driver has a fixed size (moments, D x D sums, bins).

    The ridge weights come from all rows; the calibration from scores of each fold by the weights of the other, so no row calibrates a
    score that it has shaped (a fold without rows lends the weights of all). Without rows of both labels the model scores everything at the only label seen, or at 0.5.
    """
    at = range(len(STATISTICS))
    moments = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones"), *[f(F.col("statistics")[i]).alias(f"{name}{i}") for name, f in (("m", F.avg), ("s", F.stddev_pop)) for i in at]).first()
    draw = np.random.default_rng(seed)
    waves, phases = draw.normal(size=(len(STATISTICS), n_features)) / width, draw.uniform(0, 2 * np.pi, n_features)
    if moments.ones in (0, moments.n):
        level = 0.5 if not moments.n else float(moments.ones > 0)
        return Model(np.zeros(len(at)), np.ones(len(at)), waves, phases, levels=np.array([level]))
    model = Model(np.array([moments[f"m{i}"] for i in at]), np.maximum(np.array([moments[f"s{i}"] for i in at]), 1e-6), waves, phases)
    shares = in_arrow(labelled.select("statistics", "label", "fold"), sum_in_tasks(model), "fold int, i int, sums array<double>")
    summed = {(r.fold, r.i): np.array(r.sums) for r in shares.groupBy("fold", "i").applyInArrow(add_up, "fold int, i int, sums array<double>").collect()}
    size = n_features + 1
    folds = [np.array([summed[f, i] for i in range(size)]) if (f, 0) in summed else np.zeros((size, size + 1)) for f in (0, 1)]

    def solved(system: np.ndarray) -> np.ndarray:
        n = system[-1, -2]  # the constant feature's square adds up to the number of rows
        return np.linalg.solve(system[:, :-1] + ridge * n * np.eye(size) / n_features, system[:, -1])

    model.weights = solved(folds[0] + folds[1])
    models = [replace(model, weights=solved(f)) if f[-1, -2] else model for f in folds]
    raw = in_arrow(labelled.select("statistics", "label", "fold"), raw_in_tasks(models), "raw double, label int")
    bin_ = F.least(F.greatest(F.floor((F.col("raw") + 1) * (bins / 3)), F.lit(0)), F.lit(bins - 1))
    binned = sorted((r.m, r.y, r.n) for r in raw.groupBy(bin_.alias("bin")).agg(F.avg("raw").alias("m"), F.avg("label").alias("y"), F.count("*").alias("n")).collect())
    model.knots, model.levels = isotonic(*(np.array(c, float) for c in zip(*binned)))
    return model


def learnt(measured: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> Model:
    """The model of the labels whose rows are not held out; measured: doc_id, statistics."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id")) != 1))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(2)).cast("int")
    return fit(materialize(measured.join(known, "doc_id").select("statistics", "label", fold.alias("fold")), "labelled"))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: Sequence[str] = ()) -> DataFrame:
    """Returns doc_id, held_out, score, predicted and the columns to keep for every row of docs.

    Learns from labels whose crc32(doc_id as text) leaves another remainder than 1 by 3; the others are held out. Only
    statistics of the text enter a score. Null and empty texts are scored like others; null labels and labels of
    unknown documents are left out; a document labelled twice counts twice; repeated rows are each scored; empty tables
    give no rows, or scores of 0.5. The statistics are counted in one pass and kept as a narrow table; the one shuffle is that of
    narrow rows to their labels.
    """
    measured = materialize(measure(docs, id_col, text_col, keep), "statistics")
    model = learnt(measured.select("doc_id", "statistics"), labels, id_col, label_col)
    scored = in_arrow(measured, score_in_tasks(model), columns_of(measured, "statistics", StructField("score", DoubleType())))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)


def select_in_tasks(model: Model, text_col: str, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.array([statistics(t or "") for t in batch.column(text_col).to_pylist()], float)
                yield batch.filter(pa.array(np.round(model.score(found), 9) >= least, pa.bool_()))

    return run


def good_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of docs that classify() predicts as 1, with all their columns, however named; each row is judged where it stands, with or without an id.

    The statistics of labelled documents are found in one scan, all texts are scored in another: counting twice costs less than a
    shuffle of whole texts to their scores. Nulls, repeats and empty tables are as in classify.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    wanted = labels.where(F.col(label_col).cast("int").isin(0, 1)).select(F.col(id_col).cast("bigint").alias("_id"))
    model = learnt(measure(likely_members(narrow, "doc_id", wanted, "_id")), labels, id_col, label_col)
    return in_arrow(docs, select_in_tasks(model, text_col, least), columns_of(docs, ""))
