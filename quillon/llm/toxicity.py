"""Toxicity by a weighted grammar of clauses.

An automaton over the lower-cased text finds where an insult or threat may begin: whole words and stems, learnt with their
weights of evidence from labelled rows. Each clause with a match is read by one machine, the composition of three weighted
transducers: negation and reported speech, target, threat. Each of them remembers for REACH words that its class has been
seen; the composition is their product, one table of states by classes of words, built once. What it puts out for a word says
under which reading its weight counts: plain, turned (negated or reported), directed (at a target), and whether a threat meets
its target. A text is scored on its clauses by a logistic model fitted on the same sample: no isolated word scores outside its
clause. A threat that the sample does not weigh counts where it meets a target.

The sample is bounded (SAMPLE labelled documents, half of each label where there are so many, by smallest hash of the id); of
it, only the LEXICON strongest patterns, the weights of the threats and one row of READINGS numbers a document are collected.

Time is linear in the text: matches, clause ends and words are each walked once, in order.

Cases. Null or empty text has no clause and gets the score of such texts. Null labels are not learnt from. With nothing to
learn from, every score is PRIOR. Repeated rows get equal scores. Very long texts are read whole. An empty table gives an
empty result. Id, language and source are not features; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches
from quillon.llm.quality import sampled

SAMPLE, LEXICON, STEMS, REACH, PRIOR = 8192, 2048, (4, 5, 6, 7), 4, 0.1
#: Toxic documents that must have a pattern before it is learnt, and how many times likelier it must make the label.
LEAST, LIKELIER = 4, 4.0
READINGS = 8

# Words of the transducers.
TARGETS = set("you your yours yourself he she him her they them these those tu te toi vous votre ton du dich dir euch ihr sie er usted tú él ella ellos".split())
THREATS = set("kill hurt destroy burn beat shoot stab crush tuer frapper détruire töten schlagen vernichten matar golpear destruir".split())
NEGATIONS = set("not no never isn't aren't wasn't nor without ne pas jamais sans nicht kein keine nie ohne nunca sin".split())
REPORTS = set("said says wrote writes claimed claims called calls told quoted reported dit écrit sagte schrieb dijo escribió".split())

# Classes of words, as bits of a symbol.
NEGATED, REPORTED, TARGET, THREAT, INSULT = 1, 2, 4, 8, 16
CLASS = {w: sum(bit for bit, some in ((NEGATED, NEGATIONS), (REPORTED, REPORTS), (TARGET, TARGETS), (THREAT, THREATS)) if w in some) for w in NEGATIONS | REPORTS | TARGETS | THREATS}

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.;:!?](?=\s)|\n")


class Transducer:
    """States (0 is the first), a table of the next state by state and symbol, and what each state stands for."""

    def __init__(self, follows: np.ndarray, near: list[frozenset[str]]) -> None:
        self.follows, self.near = follows, near

    @classmethod
    def memory(cls, name: str, classes: int, reach: int = REACH) -> Transducer:
        """Remembers for ``reach`` words that a word of ``classes`` was read: state 0 none, state k + 1 read k words ago."""
        states = reach + 2
        follows = np.array([[1 if symbol & classes else (k + 1) % states if k else 0 for symbol in range(32)] for k in range(states)])
        return cls(follows, [frozenset()] + [frozenset([name])] * (reach + 1))

    def composed(self, other: Transducer) -> Transducer:
        """Both at once: the product of the states, each reading the same symbols."""
        n = len(other.near)
        follows = (self.follows[:, None, :] * n + other.follows[None, :, :]).reshape(-1, self.follows.shape[1])
        return Transducer(follows, [x | y for x in self.near for y in other.near])


#: Readings of a word, as bits of an output.
PLAIN, TURNED, DIRECTED, MEETS = 1, 2, 4, 8


def _outputs(machine: Transducer) -> list[list[int]]:
    """What each state, once reached by a symbol, puts out."""
    table = []
    for near in machine.near:
        row = []
        for symbol in range(32):
            out = 0
            if symbol & INSULT:
                out |= TURNED if "turn" in near else PLAIN | (DIRECTED if "target" in near else 0)
            if symbol & (TARGET | THREAT) and {"target", "threat"} <= near and "turn" not in near:
                out |= MEETS
            row.append(out)
        table.append(row)
    return table


MACHINE = Transducer.memory("turn", NEGATED | REPORTED).composed(Transducer.memory("target", TARGET)).composed(Transducer.memory("threat", THREAT))
FOLLOWS, OUTPUTS = MACHINE.follows.tolist(), _outputs(MACHINE)


def patterns_of(text: str) -> set[str]:
    """Candidate patterns: whole words, and stems with a dash behind."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


class Grammar:
    """Weighted patterns and the transducers over clauses."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        # a word and a stem of the same letters are two entries of one key
        entries: dict[str, list[tuple[int, bool, float]]] = {}
        for p, w in [*weights.items(), *((p, 0.0) for p in THREATS if p not in weights)]:
            entries.setdefault(p.rstrip("-"), []).append((len(p.rstrip("-")), p.endswith("-"), w))
        for p, own in entries.items():
            self.automaton.add_word(p, own)
        if len(self.automaton):
            self.automaton.make_automaton()

    def clauses(self, text: str):
        """(begin, end, {word's begin: weight}) of every clause with a match."""
        if not len(self.automaton):
            return
        hits: dict[int, float] = {}
        n = len(text)
        for end, own in self.automaton.iter(text):
            for size, stem, w in own:
                at = end - size + 1
                if (at and text[at - 1].isalpha()) or (not stem and end + 1 < n and text[end + 1].isalpha()):
                    continue
                hits[at] = max(hits.get(at, 0.0), w)
        if not hits:
            return
        order = sorted(hits)
        begin = k = 0
        for m in CLAUSE_END.finditer(text):
            if order[k] < m.end():
                own = {}
                while k < len(order) and order[k] < m.end():
                    own[order[k]] = hits[order[k]]
                    k += 1
                yield begin, m.start(), own
                if k == len(order):
                    return
            begin = m.end()
        yield begin, n, {at: hits[at] for at in order[k:]}

    def readings(self, text: str | None) -> np.ndarray:
        """What a text's clauses put out: counts and weights by reading, all damped by logarithms, and per word."""
        text = (text or "").lower()
        clauses = matches = 0
        all_plain = all_turned = all_directed = best = 0.0
        for begin, end, hits in self.clauses(text):
            state = found = 0
            plain = turned = directed = 0.0
            for m in WORD.finditer(text, begin, end):
                symbol, w = CLASS.get(m.group(), 0), hits.get(m.start(), 0.0)
                if w:
                    symbol |= INSULT
                state = FOLLOWS[state][symbol]
                out = OUTPUTS[state][symbol]
                if out:
                    if out & (PLAIN | TURNED):
                        found += 1
                    if out & PLAIN:
                        plain += w
                    elif out & TURNED:
                        turned += w
                    if out & DIRECTED:
                        directed += w
                    if out & MEETS:
                        directed += 1
            clauses += found > 0
            matches += found
            all_plain += plain
            all_turned += turned
            all_directed += directed
            best = max(best, plain + 0.5 * turned)
        words = 1 + len(text) / 6
        return np.array([1.0, np.log1p(clauses), np.log1p(matches), np.log1p(all_plain), np.log1p(all_directed), np.log1p(all_turned), np.log1p(best), np.log1p(1000 * matches / words)])


class Model:
    def __init__(self, grammar: Grammar, readings: np.ndarray, labels: np.ndarray, share: float) -> None:
        self.grammar, self.theta = grammar, None
        if not len(labels):
            return
        x, y = readings, labels.astype(float)
        # rows weigh as their label does among all labelled rows, not as in the halved sample
        weigh = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9)) if 0 < y.mean() < 1 else np.ones(len(y))
        theta = np.zeros(x.shape[1])
        ridge = np.full(x.shape[1], 1e-2 * len(y) ** 0.5)
        ridge[0] = 1e-3
        for _ in range(40):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            g = x.T @ (weigh * (p - y)) + ridge * theta
            h = (x * (weigh * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
            theta = theta - np.linalg.solve(h, g)
        self.theta = theta

    def score(self, text: str | None) -> float:
        if self.theta is None:
            return PRIOR
        return float(1 / (1 + np.exp(-np.clip(self.grammar.readings(text) @ self.theta, -30, 30))))


def narrowed(strong: list) -> dict[str, float]:
    """(pattern, weight, documents) without stems that stand for nine tenths or more of one longer pattern."""
    inner: dict[str, int] = {}
    for pattern, _, k in strong:
        bare = pattern.rstrip("-")
        for size in STEMS:
            if size < len(bare) or (size == len(bare) and bare == pattern):
                inner[bare[:size] + "-"] = max(inner.get(bare[:size] + "-", 0), k)
    return {p: w for p, w, k in strong if not p.endswith("-") or inner.get(p, 0) < 0.9 * k}


def _counted(batches):
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            (toxic if label else clean).update(patterns_of(text or ""))
        words = list(set(toxic) | set(clean))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["pattern", "toxic", "clean"])


def _read(shared):
    def read(batches):
        grammar = shared.value
        for batch in batches:
            rows = [grammar.readings(t).tolist() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], ["id", "label", "readings"])

    return read


def fitted(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """The model of the labelled rows for which the column ``learn`` holds."""
    spark = docs.sparkSession
    small_batches(spark)
    share = labels.where(learn).where(F.col(label_col).isin(0, 1)).agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    chosen = F.broadcast(sampled(labels, learn, id_col, label_col, sample))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id").select("id", "label", "text")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    counts = rows.mapInArrow(_counted, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
    strong = counts.where((F.col("toxic") >= LEAST) & (ratio >= LIKELIER)).select("pattern", F.log(ratio).alias("weight"), "toxic").orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "pattern").limit(LEXICON)
    known = narrowed(strong.collect())
    threats = counts.where(F.col("pattern").isin(*sorted(THREATS))).select("pattern", F.greatest(F.log(ratio), F.lit(0.0)).alias("weight"))
    known |= {p: w for p, w in threats.collect() if p not in known}
    grammar = Grammar(known)
    shared = spark.sparkContext.broadcast(grammar)
    found = rows.mapInArrow(_read(shared), "id long, label int, readings array<double>").toArrow()
    readings = np.array(found["readings"].to_pylist()).reshape(-1, READINGS)
    return Model(grammar, readings, np.array(found["label"].to_pylist()), share or 0.0)


def _scorer(shared):
    def score(batches):
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

    return score


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score, from 0 to 1, of each row of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), "id long, score double").withColumnRenamed("id", id_col)
