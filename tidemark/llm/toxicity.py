"""Toxicity by a weighted finite-state grammar over clauses.

Lexical transducer: words become symbols - insult, threat, target, negation, reported
speech, other. The insult lexicon is a short seed list plus stems mined from the
labelled training rows: words and word beginnings that toxic rows have far more often
than chance allows over all candidates. Each entry carries its log-odds as weight.

Three more transducers work on a clause's symbols: negation marks insults and threats
within three words of a negation, reported speech those after a speech verb or inside
quotes, target those in a clause that addresses somebody. Their composition is one
machine; its output for a clause is a list of matches such as ``insult+target`` or
``insult-negated``. A document's features are the log of the summed weights for each
kind of match; a logistic model fitted on the training rows turns them into the score.

Only rows given as training rows are learned from, at most ``TRAIN_ROWS`` of them (by a
hash of the id). Labels, language, source and id are no inputs of a
score. Defined cases: null and empty texts match nothing and get the score of the
intercept; with no training row of either label a fixed weight for each match is used;
repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import store, vocab

TRAIN_ROWS = 20_000
STEM_SIZES = (4, 5, 6)
STEMS_KEPT = 2000

# Word lists of the grammar, four languages.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumbass bastard idiote imbécile crétin connard salaud dummkopf trottel arschloch abschaum estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy punch beat shoot strangle burn tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = "you your yours u he she they them these those people tu toi vous ton votre du dich dein ihr euch sie tú usted ustedes ellos".split()
NEGATIONS = "not no never none neither nor isn't aren't wasn't don't doesn't didn't ne pas jamais aucun nicht kein keine nie niemals nunca jamás ningún".split()
REPORTS = "said says wrote writes claimed claims called quoted according reported dit disait écrit selon sagte sagt schrieb laut dijo dice escribió según".split()

WORD = re.compile(r"[\w'’]+|[\"“”«»]")
CLAUSE = re.compile(r"[.!?;:\n]+")


class Transducer:
    """A deterministic transducer: ``step(state, symbol) -> (state, symbol out)`` over a start state."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __matmul__(self, after: Transducer) -> Transducer:
        """The composition: this one's output feeds the next."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            theirs, out = after.step(state[1], out)
            return (mine, theirs), out

        return Transducer((self.start, after.start), step)

    def compiled(self, symbols) -> dict:
        """(state, symbol) -> (state, output) for all states reachable over the symbols."""
        table, todo = {}, [self.start]
        seen = {self.start}
        while todo:
            state = todo.pop()
            for s in symbols:
                nxt, out = self.step(state, s)
                table[state, s] = nxt, out
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return table


def _negation(state: int, s: tuple):
    if s[0] == "negation":
        return 3, s
    return max(0, state - 1), ((*s, "negated") if state and s[0] in ("insult", "threat") else s)


def _report(state: tuple, s: tuple):
    told, quoted = state
    if s[0] == "report":
        return (True, quoted), s
    if s[0] == "quote":
        return (told, not quoted), s
    return state, ((*s, "reported") if (told or quoted) and s[0] in ("insult", "threat") else s)


def _target(state: int, s: tuple):
    if s[0] == "target":
        return 4, s
    return max(0, state - 1), ((*s, "target") if state and s[0] in ("insult", "threat") else s)


SYMBOLS = [(x,) for x in ("other", "insult", "threat", "target", "negation", "report", "quote")]
GRAMMAR = (Transducer(0, _negation) @ Transducer((False, False), _report) @ Transducer(0, _target)).compiled(SYMBOLS)
START = ((0, (False, False)), 0)
KINDS = sorted({out for _, out in GRAMMAR.values() if out[0] in ("insult", "threat")})
_CLASS = {w: (kind,) for kind, ws in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS), ("threat", THREATS), ("quote", ['"', "“", "”", "«", "»"])) for w in ws}


class Lexicon:
    """Insult words and stems with weights, as one automaton for finding clauses worth a look."""

    def __init__(self, whole: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.whole, self.stems = whole, stems
        self.automaton = ahocorasick.Automaton()
        for w in {*whole, *stems, *THREATS}:
            self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def weight(self, word: str) -> float | None:
        best = self.whole.get(word)
        for k in STEM_SIZES:
            if len(word) >= k and (w := self.stems.get(word[:k])) is not None and (best is None or w > best):
                best = w
        return best

    def features(self, text: str | None) -> np.ndarray:
        """A value for each kind of match: log(1 + sum of weights); and the same over all of them."""
        sums = np.zeros(len(KINDS) + 1, np.float32)
        low = (text or "").lower()
        done = -1
        for end, size in self.automaton.iter(low):
            begin = end - size + 1
            if begin <= done or (begin and low[begin - 1].isalnum()):
                continue
            left = max(low.rfind(c, max(0, done), begin) for c in ".!?;:\n") + 1
            found = CLAUSE.search(low, end)
            done = found.start() if found else len(low)
            for out, w in self.clause(low[left:done]):
                sums[KINDS.index(out)] += w
        sums[-1] = sums[:-1].sum()
        return np.log1p(sums)

    def clause(self, clause: str) -> list[tuple[tuple, float]]:
        """The composed machine's matches in a clause, with the weights of their words."""
        state, found = START, []
        for word in WORD.findall(clause):
            w = self.weight(word)
            symbol = ("insult",) if w is not None else _CLASS.get(word, ("other",))
            state, out = GRAMMAR[state, symbol]
            if out[0] in ("insult", "threat"):
                found.append((out, w if w is not None else 1.0))
        return found


def _candidates(text: str) -> set[tuple[str, int]]:
    found = set()
    for word in set(re.findall(r"\w+", text.lower())):
        found.add((word, 0))
        found.update((word[:k], k) for k in STEM_SIZES if len(word) > k)
    return found


def mine(train: DataFrame, seeds: float = 3.0) -> tuple[dict[str, float], dict[str, float]]:
    """(whole words, stems) with weights from rows (text, toxic).

    Candidates are counted by documents of either label, first within each task. One is
    kept if the likelihood ratio of its toxic share against the base rate beats the log
    of the number of candidates by two.
    """

    def count(batches):
        seen: dict = {}
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for c in _candidates(text or ""):
                    n = seen.setdefault(c, [0, 0])
                    n[int(toxic)] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())], names=["piece", "size", "clean", "toxic"])

    base = train.agg(F.count("*"), F.sum("toxic")).first()
    whole, stems = dict.fromkeys(INSULTS, seeds), {}
    n, bad = base[0] or 0, base[1] or 0
    if not 0 < bad < n:
        return whole, stems
    rate = bad / n
    counted = train.select("text", "toxic").mapInArrow(count, "piece string, size int, clean long, toxic long").groupBy("piece", "size").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic >= 3 or clean >= 3")
    both = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / both
    ratio = F.col("toxic") * F.log(share / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1)) - F.log((F.col("clean") + 0.5) / (n - bad + 1))
    scored = counted.select("piece", "size", ratio.alias("ratio"), share.alias("share"), odds.alias("odds"))
    total = F.lit(max(1.0, math.log(max(2, n * 200)) + 2))
    for r in scored.where((F.col("ratio") > total) & (F.col("share") >= 0.5) & (F.col("odds") >= 2)).orderBy(F.desc("ratio"), "piece", "size").limit(STEMS_KEPT).collect():
        (stems if r["size"] else whole)[r["piece"]] = min(6.0, float(r["odds"]))
    return whole, stems


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method; the last column is the intercept, not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model:
    """A fitted toxicity model: lexicon and weights of the kinds of matches."""

    def __init__(self, whole, stems, weights):
        self.whole, self.stems, self.weights = whole, stems, weights

    def lexicon(self) -> Lexicon:
        return Lexicon(self.whole, self.stems)


def train(rows: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """A model from rows (doc_id, text, toxic 0/1); rows with a null label are left out."""
    rows = rows.where("toxic is not null").select("text", "toxic").limit(limit)
    rows = store.table(rows, "toxicity-train").repartition(max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    whole, stems = mine(rows)

    def describe(batches):
        lexicon = Lexicon(whole, stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.features(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary()), batch.column("toxic").cast(pa.int32())], names=["x", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(describe, "x binary, toxic int").collect()
    y = np.array([r[1] for r in got], np.float64)
    if len(got) and 0 < y.sum() < len(y):
        weights = _fit(np.array([np.frombuffer(r[0], np.float32) for r in got]), y)
    else:
        weights = np.array([0.0] * len(KINDS) + [2.0, -3.0])
    return Model(whole, stems, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1, higher: more likely toxic), clauses (weighted matches) of every whole text."""
    spark = docs.sparkSession
    vocab.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("matched", pa.float64())])

    def run(batches):
        lexicon, w = sent.value.lexicon(), sent.value.weights
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(KINDS) + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p), pa.array(np.expm1(x[:, -1]))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, matched double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a score below the threshold; one pass, no shuffle."""
    spark = docs.sparkSession
    vocab.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        lexicon, w = sent.value.lexicon(), sent.value.weights
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(KINDS) + 1)
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by five: such rows are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled rows that may be learned from. Labels are thinned to a bounded number before texts join."""
    few = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select("doc_id", "toxic")
    few = store.table(store.bounded_sample(few, few.count(), TRAIN_ROWS, "doc_id").dropDuplicates(["doc_id"]), "toxicity-labels")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


