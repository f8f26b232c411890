"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as clauses of words. A lexicon transducer turns each word into a symbol: insult or threat, with a weight, target, negation, report,
quotation mark or other. Three transducers are composed with it into one table: negation marks insults and threats within its
scope, reported speech those after a verb of saying or within quotation marks, the target machine those near the person addressed. What comes out
of a clause are weights by pattern (plain, negated, reported, directed insults and threats); a document is judged by its clauses' patterns,
not by single words.

The weights are learned from labels. Arcs of the insult lexicon are beginnings of words and whole words whose share among toxic documents is
larger than among others, so inflected forms that no labelled text had are met by their stem; weights of the patterns come from a logistic fit
on features that each labelled document gets from a lexicon without its own fold.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import Memo, in_arrow, materialize

# The closed classes of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours yourself u he she they them his her their du dich dir dein deine ihr euch sie tu te toi ton ta vous votre il elle ils elles tú tu ti usted ustedes vosotros él ella ellos ellas"
NEGATIONS = "not no never nobody nothing isn't aren't wasn't weren't don't doesn't didn't nicht kein keine keinen nie niemals ne pas jamais aucun aucune non nunca jamás ni tampoco"
REPORTS = "said says say saying wrote writes called calls claimed claims quoted quotes according alleged sagte sagt schrieb schreibt nannte nennt laut behauptet dit disait écrit appelé selon prétend dijo dice escribió llamó según afirma"
THREATS = "kill hurt destroy beat burn shoot stab die töten umbringen verprügeln verbrennen erschießen tuer frapper détruire brûler crever matar golpear destruir quemar morir"
INSULTS = "stupid idiot moron loser scum trash worthless pathetic disgusting clown dumb fool dumm idiot trottel abschaum versager wertlos imbécile idiot stupide nul ordure minable estúpido idiota imbécil basura inútil patético"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
SYMBOLS = 7
NEGATED, REPORTED, DIRECTED = 1, 2, 4
#: Words that a negation, a target before and a target after an insult reach.
NEGATION_SCOPE, TARGET_SCOPE, TARGET_AFTER = 3, 4, 2
#: Lengths of the beginnings of words that may be arcs, and of whole words at most.
STEMS, LONGEST = range(3, 9), 32
FOLDS = 4
#: Weight of a listed insult or threat as long as no label says otherwise.
PRIOR = 2.0
WORD = re.compile(r"[\w'’]+|[.!?;:\n]|[\"“”„«»]")


# --- transducers


@dataclass
class Transducer:
    """A deterministic transducer over (symbol, flags): step[state][symbol] is (next state, flags to add)."""

    step: list[list[tuple[int, int]]]

    def __or__(self, after: "Transducer") -> "Transducer":
        """The composition: after reads what self writes. Symbols pass through, flags add up; only states that can be reached are built."""
        states, table, todo = {(0, 0): 0}, [], [(0, 0)]
        for p, q in todo:
            row = []
            for symbol in range(SYMBOLS):
                (p2, f), (q2, g) = self.step[p][symbol], after.step[q][symbol]
                if (p2, q2) not in states:
                    states[p2, q2] = len(states)
                    todo.append((p2, q2))
                row.append((states[p2, q2], f | g))
            table.append(row)
        return Transducer(table)

    def run(self, symbols: list[int]) -> list[int]:
        """The flags of each symbol of a clause."""
        state, out = 0, []
        for s in symbols:
            state, flags = self.step[state][s]
            out.append(flags)
        return out


def negation() -> Transducer:
    """States: how many words the scope still holds."""
    return Transducer([[(NEGATION_SCOPE if s == NEGATION else max(left - 1, 0), NEGATED if left and s in (INSULT, THREAT) else 0) for s in range(SYMBOLS)] for left in range(NEGATION_SCOPE + 1)])


def reported_speech() -> Transducer:
    """States: own words, after a verb of saying (to the end of the clause), within quotation marks."""
    to = lambda state, s: (0 if state == 2 else 2) if s == QUOTE else 1 if s == REPORT and state == 0 else state
    return Transducer([[(to(state, s), REPORTED if state and s in (INSULT, THREAT) else 0) for s in range(SYMBOLS)] for state in range(3)])


def target() -> Transducer:
    """States: words that a target still reaches, times words that an insult waits for one; a target met while one waits directs it."""
    states = [(t, w) for t in range(TARGET_SCOPE + 1) for w in range(TARGET_AFTER + 1)]
    at = {s: k for k, s in enumerate(states)}
    table = []
    for t, w in states:
        row = []
        for s in range(SYMBOLS):
            hit = s in (INSULT, THREAT)
            flag = DIRECTED if hit and t or s == TARGET and w else 0
            row.append((at[TARGET_SCOPE if s == TARGET else max(t - 1, 0), (0 if t else TARGET_AFTER) if hit else 0 if s == TARGET else max(w - 1, 0)], flag))
        table.append(row)
    start = at[0, 0]
    return Transducer([table[start], *table[:start], *table[start + 1 :]]) if start else Transducer(table)


GRAMMAR = negation() | reported_speech() | target()


# --- lexicon


def listed() -> dict[str, tuple[int, float]]:
    """The closed classes: word to (symbol, weight)."""
    found = {}
    for words, symbol in ((INSULTS, INSULT), (THREATS, THREAT), (REPORTS, REPORT), (TARGETS, TARGET), (NEGATIONS, NEGATION)):
        found |= {w: (symbol, PRIOR if symbol in (INSULT, THREAT) else 0.0) for w in words.split()}
    return found


def arcs_of(word: str) -> list[str]:
    """Names of the arcs a word may take, the most specific first: the whole word, then its beginnings."""
    return [f"={word[:LONGEST]}", *[word[:n] for n in reversed(STEMS) if len(word) > n]]


class Lexicon:
    """The first transducer: words of a text to symbols and weights. arcs: name to weight, learned; the listed words stand in beside them."""

    def __init__(self, arcs: dict[str, float], cap: int = 200_000):
        self.arcs, self.listed = arcs, listed()
        self.parts = Memo(self.read, cap)

    def symbol(self, word: str) -> tuple[int, float, str]:
        for name in arcs_of(word):
            weight = self.arcs.get(name)
            if weight is not None:
                kind = self.listed.get(word, (INSULT, 0))[0]
                return (kind if kind == THREAT else INSULT), weight, name
        kind, weight = self.listed.get(word, (OTHER, 0.0))
        return kind, weight, word

    def read(self, part: str) -> tuple:
        """What stands between two spaces: (whether an insult or threat is in it, its words' symbols; None ends a clause)."""
        out = []
        for token in WORD.findall(part.lower()):
            if token in ".!?;:\n":
                out.append(None)
            elif token in "\"“”„«»":
                out.append((QUOTE, 0.0, token))
            else:
                out.append(self.symbol(token.replace("’", "'").strip("'")))
        return any(s is not None and s[0] in (INSULT, THREAT) for s in out), tuple(out)


FEATURES = ("plain", "negated", "reported", "directed", "threat", "directed_threat", "clauses", "best", "mean", "kinds", "density", "size")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """What a document's clauses hold, by the names above; zeros but for its size if no clause matches."""
    parts = text.split(" ")
    read = lexicon.parts
    if not any([read[p][0] for p in set(parts)]):
        return [0.0] * (len(FEATURES) - 1) + [float(np.log1p(len(parts)))]
    sums, clauses, best, hits, kinds, words = [0.0] * 6, 0, 0.0, 0, set(), 0
    clause: list[tuple[int, float, str]] = []
    for symbol in [s for p in parts for s in read[p][1]] + [None]:
        if symbol is not None:
            clause.append(symbol)
            continue
        words += len(clause)
        if any(s[0] in (INSULT, THREAT) for s in clause):
            total, last = 0.0, None
            for (kind, weight, name), flags in zip(clause, GRAMMAR.run([s[0] for s in clause])):
                if kind in (INSULT, THREAT):
                    pattern = 1 if flags & NEGATED else 2 if flags & REPORTED else (5 if kind == THREAT else 3) if flags & DIRECTED else 4 if kind == THREAT else 0
                    sums[pattern] += weight
                    total += weight
                    hits += 1
                    kinds.add(name)
                    last = (kind, weight, pattern)
                elif kind == TARGET and flags & DIRECTED and last and last[2] in (0, 4):  # the target comes after the insult
                    sums[last[2]] -= last[1]
                    sums[5 if last[0] == THREAT else 3] += last[1]
                    last = None
            clauses += 1
            best = max(best, total)
        clause = []
    return [*np.log1p(np.maximum(sums, 0)).tolist(), float(np.log1p(clauses)), best, sum(sums) / max(hits, 1), float(np.log1p(len(kinds))), float(np.sqrt(hits / max(words, 1))), float(np.log1p(len(parts)))]


# --- learning


@dataclass
class Model:
    """The lexicon's arcs and the weights of the patterns; its size is bounded by LEXICON arcs."""

    arcs: dict[str, float]
    center: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Without labels of both kinds the listed words and the grammar judge alone."""
        if self.weights is None:
            raw = 1.5 * (x[:, 0] + 1.5 * x[:, 3] + x[:, 4] + 2 * x[:, 5] - 0.5 * x[:, 1] - 0.5 * x[:, 2]) - 2.5
        else:
            raw = ((x - self.center) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def count_in_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """arc, cell, n: in how many documents of each fold and label an arc's words occur, added up within the task."""
    counts: dict[tuple[str, int], int] = defaultdict(int)

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"arc": pa.array([a for a, _ in counts], pa.string()), "cell": pa.array([c for _, c in counts], pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    for batch in batches:
        for text, label, fold in zip(*[batch.column(c).to_pylist() for c in ("text", "label", "fold")]):
            words = {w.strip("'") for w in WORD.findall((text or "").lower().replace("’", "'"))}
            for arc in {a for w in words if w[:1].isalpha() for a in arcs_of(w)}:
                counts[arc, 2 * fold + label] += 1
        if len(counts) > 1_000_000:
            yield given()
            counts.clear()
    yield given()


def features_in_tasks(lexicons: list[dict[str, float]]) -> Callable:
    """The features of labelled documents, each by the lexicon of the folds it is not in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [Lexicon(arcs) for arcs in lexicons]
        for batch in batches:
            rows = [features(t or "", read[f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "x": pa.array(rows, pa.list_(pa.float64()))})

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, of a ridge logistic regression by Newton's method."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = ridge * np.diag([*[1.0] * x.shape[1], 1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """text, label, fold of at most about `most` labelled documents that are not held out: those of the least hashes of their ids.

    A document labelled twice is toxic if one label says so; of texts that share an id, one teaches. The ids go to every task: two numbers for each of `most`.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    known = materialize(known.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    share = most / max(known.count(), 1)
    place = (F.xxhash64("doc_id", F.lit(29)).cast("double") / 2.0**64) + 0.5
    sample = F.broadcast(known.where(place < share).select("doc_id", "label"))
    met = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(sample, "doc_id")
    one = met.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return materialize(one.select("text", "label", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(FOLDS)).cast("int").alias("fold")), "labelled")


#: Labelled documents that are learned from, arcs of the lexicon, toxic documents that an arc needs, and the least weight of one.
MOST, LEXICON, LEAST, WEIGHT = 20_000, 20_000, 3, 1.0


def lift(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    return F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))


def learn(labelled: DataFrame, most_arcs: int = LEXICON, least: int = LEAST) -> Model:
    """The model of the labelled rows (text, label, fold): counts of arcs by fold, lexicons, and the fit on features out of fold.

    What reaches the driver are most_arcs arcs with their counts and the features of the sample's documents.
    """
    sizes = {(r.fold, r.label): r.n for r in labelled.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    total = lambda label, but=None: sum(n for (f, one), n in sizes.items() if one == label and f != but)
    if not total(0) or not total(1):
        return Model({})
    counts = in_arrow(labelled, count_in_tasks, "arc string, cell int, n bigint")
    cells = [F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in range(2 * FOLDS)]
    each = counts.groupBy("arc").agg(*cells)
    pos, neg = (sum(F.col(f"c{2 * f + label}") for f in range(FOLDS)) for label in (1, 0))
    each = each.withColumn("pos", pos).withColumn("weight", lift(pos, neg, total(1), total(0))).where((F.col("pos") >= least) & (F.col("weight") >= WEIGHT))
    rows = each.orderBy(F.desc(F.col("pos") * F.col("weight")), "arc").limit(most_arcs).collect()

    def weights(but: int | None) -> dict[str, float]:
        found = {}
        for r in rows:
            a, b = (sum(r[f"c{2 * f + label}"] for f in range(FOLDS) if f != but) for label in (1, 0))
            w = float(np.log((a + 0.5) / (total(1, but) + 1)) - np.log((b + 0.5) / (total(0, but) + 1)))
            if w >= WEIGHT and a >= (least if but is None else least - 1):
                found[r.arc] = w
        return found

    model = Model(weights(None))
    measured = in_arrow(labelled, features_in_tasks([weights(f) for f in range(FOLDS)]), "label int, x array<double>").collect()
    x, y = np.array([r.x for r in measured]), np.array([r.label for r in measured], float)
    order = np.lexsort((*x.T, y))  # the order of rows must not show in the sums
    x, y = x[order], y[order]
    model.center, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    model.weights = logistic((x - model.center) / model.scale, y)
    return model


def score_in_tasks(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        lexicon = Lexicon(model.arcs)
        for batch in batches:
            x = np.array([features(t, lexicon) for t in batch.column("text").to_pylist()], float).reshape(-1, len(FEATURES))
            columns = {"score": pa.array(np.round(model.score(x), 9)), "patterns": pa.array(x[:, :6].tolist(), pa.list_(pa.float64()))}
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *columns.values()], names=[*names, *columns])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST) -> DataFrame:
    """Returns doc_id, held_out, score, predicted, patterns for every row of docs; patterns holds the clause weights of the first six FEATURES, as logarithms.

    Learns from at most about `most` labels whose crc32(doc_id as text) leaves a remainder by 5; the others are held out. Only the
    text enters a score. Null and empty texts are scored like texts without a match; null labels, labels of unknown documents and
    of texts that are null are left out; repeated rows are each scored; an empty table gives no rows; without labels of both kinds the
    listed words judge alone; texts of any length are read whole; other columns are not read. One scan finds the labelled texts, one scores.
    """
    model = learn(labelled_texts(docs, labels, id_col, text_col, label_col, most))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = in_arrow(narrow, score_in_tasks(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double, patterns array<double>")
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "patterns")
