"""URL filters: explicit host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything here is DataFrame expressions and Spark's own tree learner; no Python runs on the executors. The labelled
URLs are the ones that a rule judges; suffix statistics live in a table of a fixed number of hashed slots.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import materialize

#: (verdict, host and path of the rule)
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 4096
#: Folds of labelled URLs: a URL's own fold does not count in its suffix statistics.
FOLDS = 5
FEATURES = ("f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_hyphens", "f_entropy", "f_params", "f_query_length", "f_fragment", "f_secure", "f_suffix_rate", "f_suffix_share", "f_first_rate", "f_first_share", "f_last_number")


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, with A-Z lower-cased; empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does. A rule fits its host and all subdomains."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(text)
    return F.coalesce(
        F.aggregate(
            F.array_distinct(F.split(text, "")), F.lit(0.0),
            lambda sum_, c: sum_ + F.when(c == "", 0.0).otherwise((lambda k: -k / n * F.log2(k / n))((n - F.length(F.replace(text, c, F.lit("")))).cast("double"))),
        ), F.lit(0.0),
    )


def with_lexical_features(urls: DataFrame) -> DataFrame:
    """Adds host, path, the slots of the host's suffix and the path's first part, and the features that need no statistics."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    last = F.regexp_extract(path, r"(\d{1,9})(?:\.\w+)?/?$", 1)
    return (
        urls.withColumn("host", host_of(F.col("url")))
        .withColumn("path", path_of(F.col("url")))
        .withColumn("suffix_slot", F.pmod(F.xxhash64(F.regexp_extract(host, r"[^.]*$", 0), F.lit(0)), F.lit(SLOTS)).cast("int"))
        .withColumn("first_slot", F.pmod(F.xxhash64(F.regexp_extract(path, r"^/([^/]*)", 1), F.lit(1)), F.lit(SLOTS)).cast("int"))
        .withColumns(
            {
                "f_length": F.length(url), "f_host_length": F.length(host), "f_path_length": F.length(path), "f_depth": F.length(path) - _without(path, "/"),
                "f_labels": F.length(host) - _without(host, r"\.") + 1, "f_digits": (F.length(url) - _without(url, "[0-9]")) / n,
                "f_host_digits": F.length(host) - _without(host, "[0-9]"), "f_hyphens": F.length(url) - _without(url, "-"), "f_entropy": entropy(url),
                "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "f_query_length": F.length(query),
                "f_fragment": F.contains(url, F.lit("#")).cast("int"), "f_secure": url.startswith("https").cast("int"),
                "f_last_number": F.when(last == "", -1.0).otherwise(F.substring(last, 1, 1).cast("double")),
            }
        )
    )


def slot_statistics(judged: DataFrame) -> DataFrame:
    """For each kind and slot: how many URLs, and by fold how many labelled and blocked ones.

    At most 2 * SLOTS rows of fixed width by construction, whatever the input's size; counted with map-side sums.
    """
    both = judged.select(F.explode(F.array(F.struct(F.lit("suffix").alias("kind"), F.col("suffix_slot").alias("slot")), F.struct(F.lit("first").alias("kind"), F.col("first_slot").alias("slot")))).alias("s"), "label", "fold")
    sums = [F.coalesce(F.sum(F.when(F.col("fold") == k, v)), F.lit(0)).alias(f"{name}{k}") for name, v in (("l", F.col("label").isNotNull().cast("bigint")), ("b", F.col("label"))) for k in range(FOLDS)]
    counts = both.groupBy("s.kind", "s.slot").agg(F.count("*").alias("n"), *sums)
    return counts.select("kind", "slot", "n", F.array(*[f"l{k}" for k in range(FOLDS)]).alias("labelled"), F.array(*[f"b{k}" for k in range(FOLDS)]).alias("blocked"))


def with_statistics(judged: DataFrame, statistics: DataFrame) -> DataFrame:
    """Adds the smoothed share of blocked URLs of a slot, the row's own fold left out if it is labelled, and the log count of the slot's URLs.

    The slot table is bounded by its number of slots, so it is safe to send to every executor.
    """
    for kind in ("suffix", "first"):
        side = statistics.where(F.col("kind") == kind).select(F.col("slot").alias(f"{kind}_slot"), F.col("n").alias("_n"), F.col("labelled").alias("_l"), F.col("blocked").alias("_b"))
        judged = judged.join(F.broadcast(side), f"{kind}_slot", "left")
        total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
        own = lambda c: F.when(F.col("label").isNotNull(), F.get(c, F.col("fold"))).otherwise(0)
        rate = (total("_b") - own("_b") + 1.0) / (total("_l") - own("_l") + 2.0)
        judged = judged.withColumns({f"f_{kind}_rate": F.coalesce(rate, F.lit(0.5)), f"f_{kind}_share": F.coalesce(F.log1p(F.col("_n").cast("double")), F.lit(0.0))}).drop("_n", "_l", "_b")
    return judged


def sampled(labelled: DataFrame, most: int) -> DataFrame:
    """The features, label and weight of about `most` distinct labelled URLs, those of the least 64-bit hashes; the weight is how many rows have the URL.

    The share is one of distinct URLs, so a URL in a third of all rows is one row here, and it is compared as a double, so it never comes to nothing.
    """
    distinct = labelled.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    place = F.xxhash64("url", F.lit(5)).cast("double") / 2.0**64 + 0.5
    few = labelled.where(place < most / max(distinct, 1))
    return few.groupBy("url", "label").agg(F.count("*").cast("double").alias("weight"), *[F.max(f).alias(f) for f in FEATURES]).drop("url")


def fit(labelled: DataFrame, kinds: dict[int, int], most: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7):
    """Fits boosted trees to rows with url, features and a label of 0 or 1; kinds: how many rows have each label.

    Learns from a bounded sample of about `most` distinct URLs with their weights, written once; every tree level reads only that. Returns
    None if the labels have fewer than two kinds.
    """
    if not all(kinds.get(k) for k in (0, 1)):
        return None
    sample = materialize(sampled(labelled, most).select(*FEATURES, F.col("label").cast("double").alias("label"), "weight"), "url-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    rows = assembler.transform(sample).select("features", "label", "weight").coalesce(4)  # of about `most` rows
    trained = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, maxBins=32, stepSize=0.2, cacheNodeIds=False, weightCol="weight").fit(rows)
    return PipelineModel([assembler, trained])


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_col: str | None = None, most: int = 20_000) -> DataFrame:
    """Returns page_id, host, path, rule, verdict, block_score for every row of pages.

    Null URLs and URLs without :// have an empty host and path, fit no rule, and are judged by the trees like others; URLs of any length
    are read whole. Of rules that fit the longest wins; repeated rows get the same verdict; an empty table gives no rows. The trees learn
    from label_col (1: block, 0: allow, null: unknown) or, without it, from the rules' verdicts; if these are of one kind only
    (or none), the rest get that kind (or allow). Only the id, URL and label columns are read, so other names do not matter. Four scans: slot
    counts, the number of labelled URLs, a sample of about `most` of these, and scores, a map with two joins to tables of bounded size.
    """
    given = F.lit(None).cast("int") if label_col is None else F.col(label_col).cast("int")
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), given.alias("given"))
    judged = with_lexical_features(narrow).withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    label = (F.col("fit.verdict") == "block").cast("int") if label_col is None else F.col("given")
    judged = judged.withColumn("label", label).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS)).cast("int"))
    statistics = materialize(slot_statistics(judged), "slots")
    full = with_statistics(judged, statistics)
    sums = statistics.where("kind = 'suffix'").agg(*[F.sum(F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)).alias(c) for c in ("labelled", "blocked")]).first()
    n, blocked = sums.labelled or 0, sums.blocked or 0
    model = fit(full.where(F.col("label").isNotNull()), {0: n - blocked, 1: blocked}, most)
    if model is None:
        scored = full.withColumn("block_score", F.lit(float(2 * blocked > n)))
    else:
        from pyspark.ml.functions import vector_to_array

        scored = model.transform(full).withColumn("block_score", vector_to_array("probability")[1])
    learnt = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", learnt).alias("verdict"), "block_score")
