"""A gated append: cards enter a kept table only if their citations hold, point to lower layers, and no near copy is there yet.

What is refused comes back as rows of reasons; what is accepted is added by a commit of `sinks.dataset`, so a reader sees all of a batch
or none of it, and a writer that has judged against a store that has since moved on judges again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.columns import slug
from proofgrid.operators import neighbours, texts
from proofgrid.operators.order import positions
from proofgrid.sinks import dataset
from proofgrid.sinks.storage import staged

TABLE = "cards"
COLUMNS = ("card", "path", "question", "answer", "sources", "vector", "markdown")


@dataclass(frozen=True)
class Rules:
    """layers: all layers, the lowest first; home: the layer that cards go to, which may cite lower ones only; barred: layers that no card may cite.

    near, recall: what is a near copy, and the share of them to be met. family: an expression over the columns that a card is kept with; given one, only cards
    of the same family (nulls are one) can be near copies of each other, and all of these are met. Without it every card can be one of every other.
    """

    layers: tuple[str, ...]
    home: str
    barred: tuple[str, ...] = ()
    near: float = 0.9
    recall: float = 1.0
    family: str | None = None

    def lower(self) -> tuple[str, ...]:
        return self.layers[: self.layers.index(self.home)]


def first_of_near(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """b, a, cosine of what is refused if rows come one by one in order and none enters that is near one that has entered.

    pairs: a < b, cosine. Each round lets in what has no earlier undecided partner and refuses what is near it, until no pair is open: as many
    rounds as the longest chain of such decisions, not as there are rows. a is the nearest of those let in, the least one of equals.
    """
    open_ = staged(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), "cosine"), "near")
    refused = open_.limit(0)
    while not open_.isEmpty():
        entering = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        hit = staged(open_.join(entering, "a").groupBy("b").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "a")).alias("m")).select("b", "m.a", (-F.col("m.c")).alias("cosine")), "near")
        refused = refused.unionByName(hit)
        gone = hit.select("b")
        open_ = staged(open_.join(gone, "b", "left_anti").join(gone.select(F.col("b").alias("a")), "a", "left_anti"), "near")
    return refused.select("b", "a", "cosine")


def card_key(question: Column, answer: Column) -> Column:
    """The same card has the same key however often it is offered."""
    return F.sha2(F.to_json(F.array(F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit("")))), 256)


def rendered(question: Column, answer: Column, sources: Column, day: str) -> Column:
    """The card as Markdown with front matter; the format is fixed."""
    related = F.array_join(F.transform(sources, lambda s: F.concat(F.lit("  - "), s)), "\n")
    quoted = F.regexp_extract(F.to_json(F.array(question)), r"(?s)^\[(.*)\]$", 1)
    head = F.concat(F.lit("---\ntype: answer\nquestion: "), quoted, F.lit(f"\nverified: true\nverified_at: {day}\nstatus: verified\nrelated:\n"), related, F.lit("\n---\n\n# "), question)
    return F.concat(head, F.lit("\n\n"), F.regexp_replace(answer, r"\s+$", ""), F.lit("\n"))


def refusals(offered: DataFrame, stored: DataFrame, files: DataFrame, rules: Rules) -> DataFrame:
    """card, reason, detail of all that keeps offered cards (card, answer, vector) out of the store; a card without a row may enter.

    Reasons: already-stored; no-citation; those of texts.gated for each citation (missing-file, layer-not-allowed for barred layers, and so on), with the
    target; layer-not-lower; near-copy, with the stored card or the earlier accepted one of the batch. The order of a batch is that of `card`.
    files: target, layer, n_lines. A null vector is near nothing; a null answer has no citations. Cards that break another rule
    do not keep their near copies out. With rules.family both tables have the columns that its expression reads.
    """
    cited = staged(texts.gated(texts.citations(offered.select(F.col("card").alias("id"), F.coalesce("answer", F.lit("")).alias("text"))), files, [x for x in rules.layers if x not in rules.barred]), "cited")
    said = lambda df, reason, detail: df.select("card", F.lit(reason).alias("reason"), detail.cast("string").alias("detail"))
    named = cited.withColumnRenamed("id", "card")
    found = said(offered.join(stored.select("card"), "card", "left_semi"), "already-stored", F.lit(None))
    found = found.unionByName(said(offered.join(named.select("card"), "card", "left_anti"), "no-citation", F.lit(None)))
    found = found.unionByName(named.where("reason IS NOT NULL").select("card", "reason", F.col("target").alias("detail")))
    high = files.where(~F.col("layer").isin(*rules.lower())).select("target").distinct()
    found = found.unionByName(said(named.where("reason IS NULL").join(high, "target", "left_semi"), "layer-not-lower", F.col("target")))
    found = staged(found.distinct(), "refusals")
    family = [] if rules.family is None else [F.expr(rules.family).alias("family")]
    clean = offered.join(found.select("card"), "card", "left_anti").where("vector IS NOT NULL").select("card", "vector", F.lit(True).alias("fresh"), *family)
    held = stored.where("vector IS NOT NULL").select("card", "vector", F.lit(False).alias("fresh"), *family)
    seen = ["vector", "family"] if family else ["vector"]
    near = partial(neighbours.near_pairs_within, threshold=rules.near) if family else partial(neighbours.near_pairs, threshold=rules.near, recall=rules.recall)
    numbered = staged(positions(clean.unionByName(held), [F.asc("card")]).select(F.col("position").alias("id"), "card", "fresh", *seen), "numbered")
    new = numbered.where("fresh").select("id", *seen)
    old = numbered.where("NOT fresh").select("id", *seen)
    known = numbered.limit(0).selectExpr("id AS a", "id AS b", "0.0D AS cosine") if old.isEmpty() else near(new, others=old)
    copies = staged(known.groupBy("a").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "b")).alias("m")).select(F.col("a").alias("id"), F.col("m.b").alias("of")), "copies")
    rest = new.join(copies, "id", "left_anti")
    within = first_of_near(near(rest)).select(F.col("b").alias("id"), F.col("a").alias("of"))
    name = lambda i, c: numbered.select(F.col("id").alias(i), F.col("card").alias(c))
    both = copies.unionByName(within).join(name("id", "card"), "id").join(name("of", "detail"), "of")
    return found.unionByName(said(both, "near-copy", F.col("detail")))


def prepared(cards: DataFrame, day: str, rules: Rules) -> DataFrame:
    """Cards (question, answer, vector) with their key, path, sources and Markdown; repeated cards once, the one with a vector first."""
    key = card_key(F.col("question"), F.col("answer"))
    once = cards.select(key.alias("card"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    once = once.groupBy("card").agg(F.first("question").alias("question"), F.first("answer").alias("answer"), F.max("vector").alias("vector"))
    path = F.concat(F.lit(f"{rules.home}/_answers/{day}-"), slug(F.col("question")), F.lit("-"), F.substring("card", 1, 12), F.lit(".md"))
    sourced = texts.citations(once.select(F.col("card").alias("id"), F.col("answer").alias("text"))).groupBy(F.col("id").alias("card")).agg(F.array_sort(F.collect_set("target")).alias("sources"))
    both = once.join(sourced, "card", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return both.select("card", path.alias("path"), "question", "answer", "sources", "vector", rendered(F.col("question"), F.col("answer"), F.col("sources"), day).alias("markdown"))


def stored_cards(spark: SparkSession, folder: str, number: int) -> DataFrame:
    schema = "card string, path string, question string, answer string, sources array<string>, vector array<double>, markdown string"
    if not number:
        return spark.createDataFrame([], schema)
    held = dataset.read_tables(spark, folder, number)[TABLE]
    return held.select(*[F.from_json(c, "array<string>" if c == "sources" else "array<double>").alias(c) if c in ("sources", "vector") else F.col(c) for c in COLUMNS])


def append(spark: SparkSession, cards: DataFrame, folder: str, files: DataFrame, rules: Rules, day: str, tries: int = 3) -> tuple[DataFrame, DataFrame, int]:
    """(offered, refusals, commit): judges cards (question, answer, vector) against the store in folder and commits those that no rule keeps out.

    Without an accepted card nothing is written and the last commit's number is returned. If another writer commits meanwhile the cards are judged
    again, against what is there then, up to `tries` times; StaleWrite after that. A batch given twice is refused as already stored. The
    store is a table of reviewed cards: a commit writes it anew, in shards.
    """
    offered = staged(prepared(cards, day, rules), "offered")
    while True:
        tries -= 1
        parent = dataset.head(spark, folder)
        stored = stored_cards(spark, folder, parent)
        refused = staged(refusals(offered, stored, files, rules), "refused")
        fresh = offered.join(refused.select("card"), "card", "left_anti")
        if fresh.isEmpty():
            return offered, refused, parent
        whole = stored.select(*COLUMNS).unionByName(fresh.select(*COLUMNS))
        flat = staged(whole.withColumns({c: F.to_json(c) for c in ("sources", "vector")}), "cards")
        try:
            return offered, refused, dataset.publish_tables(spark, {TABLE: (flat, ["card"])}, folder, parent=parent)
        except dataset.StaleWrite:
            if tries <= 0:
                raise
