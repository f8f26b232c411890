"""A kept inverted index for BM25: postings by term in blocks with their maxima, updated by file, searched without reading the texts.

    folder/docs/gen=<g>/             id, file, n_words, range and the terms with their counts: what an update needs to take a document back out
    folder/postings/gen=<g>/slot=<s> a block a term and range: ids, counts and lengths of its documents, the most occurrences, the least length
    folder/terms/gen=<g>/slot=<s>    by how much the generation changes the number of documents of a term
    folder/dead/gen=<g>/             documents of earlier generations that the generation takes out
    folder/touched/gen=<g>/          files that the generation replaces or takes out, and any further tables by file that a caller keeps beside them
    folder/commits/<number>.json     the generations in force, and the numbers of documents and words

An update writes a generation and then a commit, a file that must not be there yet, so of two writers one is told that it is stale and a
reader sees an update whole or not at all. Documents of a generation are cut into ranges of about WIDTH neighbours in order of file and id.

A search knows from the maxima what a document of a range can reach at most. It first scores the most promising ranges of each query in
full, so it knows a score that k documents reach, and then only those ranges that can reach it: the result is that of scoring everything.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofgrid.operators import retrieval
from proofgrid.operators.order import positions
from proofgrid.operators.retrieval import K1, B, best_in_block, codes_of, placed, query_terms, tokens, top_k
from proofgrid.session import ship_package
from proofgrid.sinks.dataset import StaleWrite, head
from proofgrid.sinks.storage import get_text, names, put_new, remove, staged

SLOTS, WIDTH, PROMISING = 64, 1024, 2
#: Bounds are compared with scores that are rounded to 9 digits.
SLACK = 1e-6


def state(spark: SparkSession, folder: str, number: int | None = None) -> dict:
    """What a commit (the last, if not given) says; an empty index before the first."""
    number = head(spark, folder) if number is None else number
    return json.loads(get_text(spark, f"{folder}/commits/{number:012d}.json")) if number else {"number": 0, "generations": [], "n_docs": 0, "n_words": 0}


def slot_of(term: str | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def parts(spark: SparkSession, folder: str, said: dict, name: str, schema: str) -> DataFrame:
    """One table of all generations in force, with the generation as a column."""
    paths = [f"{folder}/{name}/gen={g}" for g in said["generations"]]
    if not paths:
        return spark.createDataFrame([], f"{schema}, gen string")
    return spark.read.option("basePath", f"{folder}/{name}").schema(f"{schema}, gen string").parquet(*paths)


DOCS = "id long, file string, n_words int, range long, terms array<string>, tfs array<int>"
POSTINGS = "term string, range long, ids array<long>, tfs array<int>, lens array<int>, n int, max_tf int, min_len int"


def dead(spark: SparkSession, folder: str, said: dict) -> DataFrame:
    """in_gen, id of documents that a later generation took out."""
    return parts(spark, folder, said, "dead", "in_gen string, id long").select("in_gen", "id")


def live_docs(spark: SparkSession, folder: str, said: dict | None = None) -> DataFrame:
    said = state(spark, folder) if said is None else said
    return parts(spark, folder, said, "docs", DOCS).join(dead(spark, folder, said).withColumnRenamed("in_gen", "gen"), ["gen", "id"], "left_anti")


def live(spark: SparkSession, folder: str, name: str, said: dict | None = None) -> DataFrame:
    """The rows of a further table that was given to updates: of each file those of the last generation that touched it."""
    said = state(spark, folder) if said is None else said
    schema = said.get("tables", {}).get(name)
    if schema is None:
        raise ValueError(f"{folder} keeps no table {name}")
    order = F.array_position(F.array(*[F.lit(g) for g in said["generations"]]), F.col("gen"))
    last = parts(spark, folder, said, "touched", "file string").groupBy("file").agg(F.max_by("gen", order).alias("gen"))
    return parts(spark, folder, said, name, schema).join(last, ["file", "gen"], "left_semi").drop("gen")


def counted_in_tasks(batches: Iterator) -> Iterator:
    """The distinct words of each document (id, file, n_words, w) in order, and how often they stand there."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        lists, n = batch.column("w"), batch.num_rows
        terms, code = codes_of(lists.flatten())
        place = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        cells, tf = np.unique(place * max(1, len(terms)) + code, return_counts=True)
        rows, code = np.divmod(cells.astype(np.int64), max(1, len(terms)))
        ends = pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (terms.take(pa.array(code)), pa.array(tf, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("file"), batch.column("n_words"), *lists], names=["id", "file", "n_words", "terms", "tfs"])


def blocks_of_range(table):
    """The postings of one range of documents (id, n_words, range, terms, tfs): a row a term, its documents in order of id."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = table.column("terms").combine_chunks()
    terms, code = codes_of(lists.flatten())
    place = np.repeat(np.arange(table.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    ids, lens = table.column("id").to_numpy()[place], table.column("n_words").to_numpy()[place]
    tf = table.column("tfs").combine_chunks().flatten().to_numpy()
    order = np.lexsort((ids, code))
    ids, lens, tf, code = ids[order], lens[order], tf[order], code[order]
    starts = np.searchsorted(code, np.arange(len(terms)))
    ends = pa.array(np.append(starts, len(code)), pa.int32())
    listed = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, tf, lens)]
    n, most, least = (np.diff(ends.to_numpy()), np.maximum.reduceat(tf, starts), np.minimum.reduceat(lens, starts)) if len(terms) else ([], [], [])
    return pa.Table.from_arrays([terms, pa.repeat(table.column("range")[0], len(terms)), *listed, *[pa.array(x, pa.int32()) for x in (n, most, least)]], names=["term", "range", "ids", "tfs", "lens", "n", "max_tf", "min_len"])


def write_generation(spark: SparkSession, folder: str, counted: DataFrame, gone: DataFrame | None, touched: DataFrame, tables: Mapping[str, DataFrame]) -> tuple[str, dict]:
    """Writes a generation of counted documents (id, file, n_words, terms, tfs), of what it takes out and of further tables; its name and its numbers."""
    ship_package(spark)
    gen = uuid.uuid4().hex
    at = lambda name: f"{folder}/{name}/gen={gen}"
    cut = positions(counted, ["file", "id"], "_at").withColumn("range", F.floor(F.col("_at") / WIDTH).cast("long")).select(*[c.split()[0] for c in DOCS.split(", ")])
    cut.write.parquet(at("docs"))
    touched.select("file").distinct().write.parquet(at("touched"))
    for name, df in tables.items():
        df.write.parquet(at(name))
    docs = spark.read.schema(DOCS).parquet(at("docs"))
    block = docs.select("id", "n_words", "range", "terms", "tfs").groupBy("range").applyInArrow(blocks_of_range, POSTINGS).withColumn("slot", slot_of("term"))  # about WIDTH documents each
    block.repartition("slot", F.expr("range div 256")).sortWithinPartitions("slot", "term", "range").write.partitionBy("slot").parquet(at("postings"))
    changes = spark.read.schema(f"{POSTINGS}, slot int").parquet(at("postings")).select("term", F.col("n").cast("long").alias("df"))
    if gone is not None:
        gone.select(F.col("gen").alias("in_gen"), "id").write.parquet(at("dead"))
        changes = changes.unionByName(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("df")))
    else:
        spark.createDataFrame([], "in_gen string, id long").write.parquet(at("dead"))
    terms = changes.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").withColumn("slot", slot_of("term"))
    terms.repartition("slot").sortWithinPartitions("slot", "term").write.partitionBy("slot").parquet(at("terms"))
    count = lambda df: df.agg(F.count("*"), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    (n, words), (less, fewer) = count(docs), count(gone) if gone is not None else (0, 0)
    return gen, {"n_docs": n - less, "n_words": words - fewer}


def commit(spark: SparkSession, folder: str, said: dict, generations: list[str], n_docs: int, n_words: int, batch: int | None, tables: Mapping[str, DataFrame]) -> int:
    number = said["number"] + 1
    schemas = said.get("tables", {}) | {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for name, df in tables.items()}
    batches = said.get("batch") if batch is None else batch
    text = json.dumps({"number": number, "generations": generations, "n_docs": n_docs, "n_words": n_words, "batch": batches, "tables": schemas, "at": time.time()})
    if not put_new(spark, f"{folder}/commits/{number:012d}.json", text):
        raise StaleWrite(f"{folder} has moved on from commit {said['number']}")
    return number


def update(spark: SparkSession, folder: str, docs: DataFrame, purge: DataFrame | None = None, batch: int | None = None, tables: Mapping[str, DataFrame] | None = None) -> int:
    """Puts documents (id, file, text) in: all that the index holds of their files goes, as does all of the files (file) to purge. The commit's number.

    Null texts have no terms but count as documents. batch is kept with the commit, for writers that must not apply a batch twice. tables are
    further tables by name, each with a column file (string), replaced by file like the documents; the same ones with each update.
    """
    said, tables = state(spark, folder), tables or {}
    files = docs.select(F.col("file").cast("string").alias("file"))
    files = staged((files if purge is None else files.unionByName(purge.select(F.col("file").cast("string").alias("file")))).distinct(), "files")
    words = tokens(F.col("text"))
    named = docs.select("id", F.col("file").cast("string").alias("file"), words.alias("w")).select("id", "file", F.size("w").alias("n_words"), "w")
    ship_package(spark)
    counted = staged(named.mapInArrow(counted_in_tasks, f"id {docs.schema['id'].dataType.simpleString()}, file string, n_words int, terms array<string>, tfs array<int>"), "counted")
    if not counted.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # what stands under one id, file and length counts together
        each = counted.select("id", "file", "n_words", F.inline_outer(F.arrays_zip("terms", "tfs"))).toDF("id", "file", "n_words", "term", "tf")
        flat = each.groupBy("id", "file", "n_words", "term").agg(F.sum("tf").cast("int").alias("tf"))
        counted = flat.groupBy("id", "file", "n_words").agg(F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf")))).alias("p"))
        counted = staged(counted.select("id", "file", "n_words", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs")), "counted")
    gone = None
    if said["generations"]:
        gone = staged(live_docs(spark, folder, said).join(files, "file", "left_semi"), "gone")
    gen, change = write_generation(spark, folder, counted, gone, files, tables)
    return commit(spark, folder, said, [*said["generations"], gen], said["n_docs"] + change["n_docs"], said["n_words"] + change["n_words"], batch, tables)


def compact(spark: SparkSession, folder: str) -> int:
    """All live documents as one generation, from what the index holds; results do not change."""
    said = state(spark, folder)
    docs, tables = live_docs(spark, folder, said).drop("gen", "range"), {name: live(spark, folder, name, said) for name in said.get("tables", {})}
    files = docs.select("file")
    for df in tables.values():
        files = files.unionByName(df.select("file"))
    gen, made = write_generation(spark, folder, docs, None, files, tables)
    return commit(spark, folder, said, [gen], made["n_docs"], made["n_words"], None, tables)


def sweep(spark: SparkSession, folder: str, keep: int = 2, grace: float = 86_400) -> list[str]:
    """Removes generations that none of the last `keep` commits names and that have not changed for `grace` seconds."""
    last = head(spark, folder)
    named = {g for n in range(max(1, last - keep + 1), last + 1) for g in state(spark, folder, n)["generations"]}
    gone = []
    for name in ("docs", "postings", "terms", "dead", "touched", *state(spark, folder).get("tables", {})):
        for gen, at in names(spark, f"{folder}/{name}"):
            if gen.removeprefix("gen=") not in named and time.time() - max([at, *[t for _, t in names(spark, f"{folder}/{name}/{gen}")]]) >= grace:
                remove(spark, f"{folder}/{name}/{gen}")
                gone.append(f"{name}/{gen}")
    return gone


class Search:
    """One batch of searches (qid, text) over the index as the last commit has it; tables are made when asked for."""

    def __init__(self, spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, keep: DataFrame | None = None):
        self.spark, self.folder, self.k, self.k1, self.b, self.keep = spark, folder, k, k1, b, keep
        self.said = state(spark, folder)
        self.asked = staged(queries.select("qid", F.explode(query_terms(F.col("text"), False)).alias("term")).distinct().withColumn("slot", slot_of("term")), "terms")
        few = [r.term for r in self.asked.select("term").distinct().limit(1000).collect()]
        #: So that the scan leaves out folders, and row groups by their least and greatest term; the join decides.
        self.slots = [r.slot for r in self.asked.select("slot").distinct().collect()]  # SLOTS at most
        self.few = few if len(few) < 1000 else None
        weights = self.of_terms("terms", "term string, df long, slot int").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        n = F.lit(float(self.said["n_docs"]))
        idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
        self.weights = staged(self.asked.join(weights, "term").select("qid", "term", "slot", idf.alias("idf")), "weights")
        self.mean = self.said["n_words"] / max(self.said["n_docs"], 1)

    def of_terms(self, name: str, schema: str) -> DataFrame:
        found = parts(self.spark, self.folder, self.said, name, schema).where(F.col("slot").isin(self.slots))
        return found if self.few is None else found.where(F.col("term").isin(self.few))

    def weight(self, idf: str, tf: str, n_words: str) -> Column:
        return F.col(idf) * F.col(tf) * (self.k1 + 1) / (F.col(tf) + self.k1 * (1 - self.b + self.b * F.col(n_words) / F.lit(float(self.mean))))

    def ranges(self) -> DataFrame:
        """qid, gen, range, reach: what a document of the range can score at most; reads the maxima, not the postings."""
        held = self.of_terms("postings", f"{POSTINGS}, slot int").select("gen", "term", "range", "max_tf", "min_len").join(self.weights, "term")
        return held.groupBy("qid", "gen", "range").agg(F.sum(self.weight("idf", "max_tf", "min_len")).alias("reach"))

    def scored(self, chosen: DataFrame) -> DataFrame:
        """qid, id, score of all live documents of the chosen (qid, gen, range): whole scores, rounded as those of bm25."""
        held = self.of_terms("postings", f"{POSTINGS}, slot int").select("gen", "term", "range", "ids", "tfs", "lens").join(self.weights, "term").join(chosen.select("qid", "gen", "range"), ["qid", "gen", "range"])
        each = held.select("qid", "gen", "idf", F.inline(F.arrays_zip("ids", "tfs", "lens"))).toDF("qid", "gen", "idf", "id", "tf", "n_words")
        each = each.withColumn("w", self.weight("idf", "tf", "n_words").cast("decimal(24,12)"))
        sums = each.groupBy("qid", "gen", "id").agg(F.sum("w").alias("s"))
        sums = sums.join(dead(self.spark, self.folder, self.said).withColumnRenamed("in_gen", "gen"), ["gen", "id"], "left_anti")
        if self.keep is not None:
            sums = sums.join(self.keep.select("id").distinct(), "id", "left_semi")
        return sums.select("qid", "id", F.round(F.col("s").cast("double"), 9).alias("score"))

    def best(self, chosen: DataFrame) -> DataFrame:
        """scored, but of each range only what may be among the k best of a query; the postings of a range and the queries that chose it meet in one task."""
        import numpy as np

        if not 0 < self.weights.count() <= retrieval.ASKED:
            return self.scored(chosen)
        ship_package(self.spark)
        pairs, qid = self.weights.select("qid", "term", "idf").toArrow(), self.weights.schema["qid"].dataType.simpleString()
        (terms, t), (qids, q) = codes_of(pairs.column("term")), codes_of(pairs.column("qid"))
        idf = np.zeros(len(terms))
        idf[t] = pairs.column("idf").to_numpy()
        searched = self.spark.sparkContext.broadcast((terms, t, idf, qids, q))
        k, k1, b, mean = self.k, self.k1, self.b, float(self.mean)

        def run(table):
            import pyarrow as pa
            import pyarrow.compute as pc

            terms, t, idf, qids, q = searched.value
            held, asked, alive = (table.filter(pc.equal(table.column("kind"), kind)) for kind in range(3))
            mine = np.zeros(len(qids), bool)
            mine[pc.index_in(asked.column("qid").combine_chunks(), qids).to_numpy(zero_copy_only=False)] = True
            code = pc.index_in(held.column("term").combine_chunks().cast(terms.type), terms).to_numpy(zero_copy_only=False)
            n = pc.list_value_length(held.column("ids").combine_chunks()).to_numpy(zero_copy_only=False)
            ids, tf, lens = (held.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "tfs", "lens"))
            term = np.repeat(code, n)
            there = np.isin(ids, alive.column("ids").combine_chunks().flatten().to_numpy())
            ids, tf, lens, term = ids[there], tf[there], lens[there], term[there].astype(np.int64)
            w = np.rint(idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens / mean)) * 1e12).astype(np.int64)
            few, place = np.unique(ids, return_inverse=True)
            local = np.cumsum(mine) - 1
            at, d, s = best_in_block(local[q[mine[q]]], t[mine[q]], place, term, w, int(mine.sum()), few, k)
            return pa.table({"qid": qids.take(pa.array(np.flatnonzero(mine)[at])), "id": pa.array(few[d], pa.int64()), "s": pa.array(s, pa.int64())})

        spans = chosen.select("gen", "range").distinct()
        held = self.of_terms("postings", f"{POSTINGS}, slot int").join(self.weights.select("term").distinct(), "term", "left_semi").join(spans, ["gen", "range"], "left_semi")
        docs = parts(self.spark, self.folder, self.said, "docs", DOCS).select("gen", "id", "range").join(spans, ["gen", "range"], "left_semi")
        docs = docs.join(dead(self.spark, self.folder, self.said).withColumnRenamed("in_gen", "gen"), ["gen", "id"], "left_anti")
        if self.keep is not None:
            docs = docs.join(self.keep.select("id").distinct(), "id", "left_semi")
        alive = docs.groupBy("gen", "range").agg(F.collect_list("id").alias("ids"))  # about WIDTH
        sides = [held.select("gen", "range", "term", "ids", "tfs", "lens"), chosen.select("gen", "range", "qid"), alive]
        union = sides[0].withColumn("kind", F.lit(0))
        for kind, side in ((1, sides[1]), (2, sides[2])):
            union = union.unionByName(side.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
        found = placed(union.groupBy("gen", "range").applyInArrow(run, f"qid {qid}, id long, s long"))
        return found.select("qid", "id", F.round(F.col("s").cast("double"), 9).alias("score"))

    def run(self) -> DataFrame:
        """qid, id, score, rank of the k best."""
        every = staged(self.ranges(), "ranges")
        order = Window.partitionBy("qid").orderBy(F.desc("reach"), "gen", "range")
        first = staged(every.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PROMISING).drop("_n"), "first")
        sure = staged(top_k(self.best(first), "score", self.k), "sure")
        floors = sure.where(F.col("rank") == self.k).select("qid", F.col("score").alias("least"))
        self.rest = staged(every.join(first.select("qid", "gen", "range"), ["qid", "gen", "range"], "left_anti").join(floors, "qid", "left").where(F.col("least").isNull() | (F.col("reach") + SLACK >= F.col("least"))), "rest")
        return top_k(sure.drop("rank").unionByName(self.best(self.rest)), "score", self.k)


def search(spark: SparkSession, folder: str, queries: DataFrame, k: int = 10, k1: float = K1, b: float = B, keep: DataFrame | None = None) -> DataFrame:
    """qid, id, score (9 digits), rank of queries (qid, text): what retrieval.bm25 gives over the live documents, token by token.

    keep (id) filters documents before ranking. Only postings of the queries' terms are read, and of these only ranges that may matter.
    """
    return Search(spark, folder, queries, k, k1, b, keep).run()
