"""SimHash fingerprints with DataFrame functions only, and a search of them by permuted block tables.

Every word votes with its hash's bits, weighted by its length. Votes are counted two bits to a long (32 sums instead
of 64), in the generated code of one hash aggregation; no array or lambda stands in the way of a word.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import bucket_of, cut_points, materialize, shuffle_partitions

PAIR = (1 << 32) | 1
LOW = (1 << 32) - 1
BREAKS = r"[\s\p{Punct}\p{IsPunctuation}]+"
#: Scripts written without spaces: each of their letters is a word of its own.
SCRIPTS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def vote_sums(word: Column) -> list[Column]:
    """Aggregates of the votes: 32 sums that hold bits k and k + 32, and the sum of weights."""
    hashed, weight = F.xxhash64(word), F.length(word).cast("bigint")
    lanes = [F.sum(F.shiftright(hashed, k).bitwiseAND(_long(PAIR)) * weight).alias(f"v{k}") for k in range(32)]
    return [*lanes, F.sum(weight).alias("weight")]


def signed_bits() -> Column:
    """The fingerprint as a long: a bit is set where the votes for it outweigh those against; 0 without votes."""
    out = _long(0)
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(_long(LOW)), F.shiftrightunsigned(F.col(f"v{k}"), 32)
        for bit, votes in ((k, low), (k + 32, high)):
            value = 1 << bit if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(votes * 2 > F.col("weight"), _long(value)).otherwise(_long(0)))
    return out


def words_of(text: Column) -> Column:
    """Lower-cased words, and single letters of scripts without spaces; never empty, as a text without words gives one of length (and weight) zero."""
    low = F.lower(text)
    return F.split(F.when(low.rlike(SCRIPTS), F.regexp_replace(low, f"({SCRIPTS})", " $1 ")).otherwise(low), BREAKS)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def fingerprints(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Returns the keys and `fingerprint` (long), one row for each distinct value of the keys; a null text has no words.

    Rows with equal keys vote together, so the keys should name a row. If docs is already distributed by one of the
    keys, nothing is shuffled; else only the sums of each key are.
    """
    words = docs.select(*keys, F.explode(words_of(F.coalesce(F.col(text_col), F.lit("")))).alias("word"))
    return words.groupBy(*keys).agg(*vote_sums(F.col("word"))).select(*keys, signed_bits().alias("fingerprint"))


def near(queries: DataFrame, all_rows: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All pairs (query, found, distance, n) of distinct fingerprints within `radius` bits, n rows of all_rows having `found`.

    Both inputs have a long column `fingerprint`. The 64 bits are cut into `blocks`; two fingerprints that differ in at
    most `radius` bits agree on some choice of blocks - radius of them, so a table for each choice, keyed by those bits moved
    to the front, meets every pair. Copies are counted first, so a fingerprint stands once in each table whatever
    its number of rows, and distances are checked within the join.
    """
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    at = [sum(widths[:k]) for k in range(blocks)]
    masks = [sum(((1 << widths[k]) - 1) << at[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(df: DataFrame, name: str, more: list[str]) -> DataFrame:
        key = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fingerprint").bitwiseAND(_long(m)).alias("bits")) for i, m in enumerate(signed)]))
        return df.select(F.col("fingerprint").alias(name), *more, key.alias("k")).select(name, *more, "k.table", "k.bits")

    asked = tables(queries.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct(), "query", [])
    counted = tables(all_rows.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.count("*").alias("n")), "found", ["n"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    pairs = asked.join(counted, (asked.table == counted.table) & (asked.bits == counted.bits) & (distance <= radius))
    return pairs.select("query", "found", distance.alias("distance"), "n").distinct()


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns block, rid, next_rid, doc_id, n_chars, text, edited: each text with its second half replaced by the next's start.

    Rows stand in descending order of (doc_id, text hash), nulls last; the next of the last is the first; a single row
    is its own next. Rows are dealt by id ranges, each neighbour found within its range; only the last row of each range is
    fetched by the range above, so no task sees the whole order.
    """
    spark = docs.sparkSession
    blocks = 4 * shuffle_partitions(spark)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = cut_points(narrow.select("doc_id"), "doc_id", blocks)
    rows = narrow.withColumn("block", bucket_of(F.col("doc_id"), cuts))
    tie = F.xxhash64("text")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), tie)
    placed = rows.withColumns({"pos": F.row_number().over(order).cast("bigint"), "below": F.lag("text").over(order)})
    # one row a range: its size and the row at its upper end
    sizes = {r.block: (r.n, r.top) for r in docs.select(F.col(id_col).alias("doc_id")).groupBy(bucket_of(F.col("doc_id"), cuts).alias("block")).agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).collect()}
    there = sorted(sizes)
    under = [(b, there[k - 1], (there[k - 1] << 32) + sizes[there[k - 1]][0]) for k, b in enumerate(there)]
    edge = spark.createDataFrame(under, "block int, source int, edge_rid bigint")
    tops = [sizes[b][1] for b in there]
    highest = rows.where(F.col("doc_id").isin([t for t in tops if t is not None]) | (F.col("doc_id").isNull() if None in tops else F.lit(False)))
    highest = highest.groupBy(F.col("block").alias("source")).agg(F.max_by("text", F.struct(F.col("doc_id"), tie)).alias("edge_text"))
    joined = placed.join(edge.join(highest, "source").drop("source"), "block", "left")
    first = F.col("pos") == 1
    n = F.length("text").cast("bigint")
    half = F.floor(n / 2).cast("int")
    following = F.when(first, F.col("edge_text")).otherwise(F.col("below"))
    rid = F.shiftleft(F.col("block").cast("bigint"), 32) + F.col("pos")
    return joined.select(
        "block", rid.alias("rid"), F.when(first, F.col("edge_rid")).otherwise(rid - 1).alias("next_rid"), "doc_id", n.alias("n_chars"), "text",
        F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(following, F.lit(1), half)).alias("edited"),
    )


def edit_report(docs: DataFrame, radius: int = 3, every: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, their likeness, and that to the next document's.

    Null texts are empty, and empty texts have fingerprint 0; equal texts have equal fingerprints; texts of any length count whole;
    repeated rows are kept, each with a next row of its own; an empty table gives no rows; other columns are not read. n_near counts, for ids divisible by `every`, the other rows
    within `radius` bits (null for other ids). One shuffle of the texts by id range; the votes are counted where the
    texts lie, and all that follows is narrow.
    """
    rows = edited_neighbours(docs, id_col, text_col)
    keys = ["block", "rid", "next_rid", "doc_id", "n_chars", "edited_sha256"]
    both = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("t"))
    prints = fingerprints(both.select(*keys, "t.which", "t.text"), [*keys, "which"])
    paired = prints.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    held = materialize(paired.drop("block"), "fingerprints")
    following = held.select(F.col("rid").alias("next_rid"), F.col("fingerprint").alias("next_fingerprint"))
    asked = held.where(F.pmod(F.col("doc_id"), F.lit(every)) == 0)
    counts = near(asked, held, radius).groupBy(F.col("query").alias("asked")).agg(F.sum("n").alias("within"))
    report = held.join(following, "next_rid").withColumn("asked", F.when(F.pmod(F.col("doc_id"), F.lit(every)) == 0, F.col("fingerprint"))).join(counts, "asked", "left")
    return report.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fingerprint")).alias("fingerprint"), as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), (F.col("within") - 1).alias("n_near"),
    )
