"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, harm verb, target, negation, reporting verb, intent,
other). Five small transducers read a clause's symbols side by side and mark it:

* insult: the clause insults, once or piled up;
* target: an insult stands within four words of a person addressed;
* threat: a harm verb meets a target, with or without stated intent;
* negation: an insult or a harm verb follows a negation within three words;
* report: it follows a reporting verb in the same clause.

Their composition is one deterministic machine whose states are tuples of theirs. A
clause is scored as a whole from the marks it ends with, never word by word; a document
from its marked clauses.

Learnt from labels of the training fold only: which words insult (stems that stand out
in toxic documents, on top of the seed list below) and the weights of the marks
(logistic regression that starts from the grammar's own weights). Both use a bounded
sample of labelled rows, ``sample_rows``; scoring covers every whole text.

Null and empty texts have no clause and get the score of a document without a match.
Repeated rows are scored each; an empty table gives an empty result; other columns are
ignored. Without any labels the seed list and the grammar's own weights are used.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_rows, held_out, materialise, table, two_columns
from .registry import register

SAMPLE_ROWS = 8_000

INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting",
           "imbecile", "dumb", "fool", "filth", "vermin", "parasite", "retard", "bastard", "bitch", "asshole")
HARM = ("kill", "hurt", "destroy", "beat", "burn", "stab", "shoot", "hang", "strangle", "murder", "smash", "punish")
TARGETS = ("you", "your", "you're", "youre", "yourself", "u", "him", "her", "them", "they", "he", "she", "these",
           "those", "people")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "wasn't", "don't", "doesn't", "won't", "without", "neither")
REPORTS = ("said", "says", "say", "called", "calls", "wrote", "writes", "claimed", "quoted", "reported", "reports",
           "according", "alleged")
INTENTS = ("will", "shall", "gonna", "going", "must", "should", "let's", "want")

#: Bits of a clause's marks and the grammar's own weights for them; MATCHED is the
#: weight of having a marked clause at all, BASE the log odds of having none.
MARKS = ("insult", "piled", "aimed", "threat", "negated", "reported")
PRIOR = (2.0, 0.5, 1.0, 3.0, -1.5, -1.0)
PRIOR_MATCHED = -1.0
PRIOR_BASE = -3.0
PRIOR_STRENGTH = 1.0

_CLAUSE_END = re.compile(r"[.!?;:|\n\r]|,\s")
_WORD = re.compile(r"[^\W_](?:[\w'’]*\w)?")


@dataclass(frozen=True)
class Transducer:
    """States are hashable; step(state, symbol) gives the next state and a mark bit."""

    start: object
    step: object


def _near(state, symbol):
    """Target: ('Y' or 'I', words left) while one of the two was just seen."""
    seen, left = state
    if symbol in ("Y", "I"):
        met = left > 0 and seen != symbol
        return (symbol, 4), 4 if met else 0
    return (seen, left - 1) if left > 1 else ("", 0), 0


def _threat(state, symbol):
    """('M', n): intent seen; ('H', n): harm verb seen, waiting for its target."""
    seen, left = state
    if symbol == "H":
        return ("H", 4), 0
    if symbol == "Y" and seen == "H":
        return ("", 0), 8
    if symbol == "M" and seen != "H":
        return ("M", 4), 0
    return (seen, left - 1) if left > 1 else ("", 0), 0


def _insult(state, symbol):
    if symbol != "I":
        return state, 0
    return min(state + 1, 2), 1 if state == 0 else 2


def _negation(state, symbol):
    if symbol == "N":
        return 3, 0
    if symbol in ("I", "H") and state:
        return state - 1, 16
    return max(state - 1, 0), 0


def _report(state, symbol):
    if symbol == "R":
        return 1, 0
    return state, 32 if state and symbol in ("I", "H") else 0


PARTS = (Transducer(0, _insult), Transducer(("", 0), _near), Transducer(("", 0), _threat), Transducer(0, _negation),
         Transducer(0, _report))


def compose(parts) -> tuple[object, dict]:
    """The reachable product machine: (state, symbol) -> (state, marks)."""
    start = tuple(p.start for p in parts)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in "IHYNRMO":
            moved = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            to, marks = tuple(m[0] for m in moved), 0
            for _, m in moved:
                marks |= m
            arcs[state, symbol] = (to, marks)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return start, arcs


@dataclass
class Grammar:
    """What scoring needs; small and independent of the data's size."""

    stems: tuple[str, ...] = INSULTS          # "word$" is the whole word, else a prefix
    weights: tuple[float, ...] = PRIOR
    matched: float = PRIOR_MATCHED
    base: float = PRIOR_BASE
    notes: dict = field(default_factory=dict)


class Matcher:
    """Runs a grammar over texts. Built once in a task."""

    def __init__(self, grammar: Grammar):
        import ahocorasick

        self.grammar = grammar
        self.find = ahocorasick.Automaton()
        for s in {*grammar.stems, *(h for h in HARM)}:
            self.find.add_word(s.rstrip("$"), len(s.rstrip("$")))
        self.find.make_automaton()
        self.whole = {s[:-1] for s in grammar.stems if s.endswith("$")}
        self.prefixes = tuple(s for s in grammar.stems if not s.endswith("$"))
        self.symbols = {}
        for letter, words in (("M", INTENTS), ("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS)):
            self.symbols.update(dict.fromkeys(words, letter))
        for h in HARM:
            self.symbols.update(dict.fromkeys((h, h + "s", h + "ed", h + "ing"), "H"))
        self.start, self.arcs = compose(PARTS)

    def symbol(self, word: str) -> str:
        got = self.symbols.get(word)
        if got:
            return got
        if word in self.whole or (self.prefixes and word.startswith(self.prefixes)):
            return "I"
        return "O"

    def clause(self, text: str) -> int:
        """Marks of one clause, lower-cased."""
        state, marks = self.start, 0
        for m in _WORD.finditer(text):
            state, got = self.arcs[state, self.symbol(m.group().replace("’", "'"))]
            marks |= got
        return marks

    def clauses(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, marks) of the marked clauses, in code points of the lower-cased
        text (as long as the text itself for all but a few letters)."""
        if not text:
            return []
        low, out, done = text.lower(), [], -1
        for last, size in self.find.iter(low):
            at = last - size + 1
            if at < done or (at and (low[at - 1].isalnum() or low[at - 1] == "_")):
                continue
            a = 0
            # The clause around the hit: from the last end before it to the next one.
            for back in range(at - 1, -1, -1):
                if low[back] in ".!?;:|\n\r" or (low[back] == "," and low[back + 1].isspace()):
                    a = back + 1
                    break
            m = _CLAUSE_END.search(low, last + 1)
            b = m.start() if m else len(low)
            done = b
            marks = self.clause(low[a:b])
            if marks & ~48:  # insult, target or threat, not only their modifiers
                out.append((a, b, marks))
        return out


def features(masks: list[int]) -> tuple[int, ...]:
    """Per mark, the bit length of the number of clauses that bear it: 0, 1, 2, 2, 3, ...
    A negated or reported clause counts only as such."""
    masks = [m & 48 or m for m in masks]
    return tuple(int(sum(m >> i & 1 for m in masks)).bit_length() for i in range(len(MARKS)))


def score_of(grammar: Grammar, masks: list[int]) -> float:
    z = grammar.base
    if masks:
        z = grammar.matched + sum(w * x for w, x in zip(grammar.weights, features(masks), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most about sample_rows labelled documents of the training
    fold, chosen by a hash of the id. Contradictory repeated labels count as 1."""
    marked = (labels.select("doc_id", F.col(label_col).cast("int").alias("y"))
              .where("doc_id is not null and y is not null").where(~held_out())
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    n = marked.count()
    if n > sample_rows:
        marked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    # At most sample_rows small rows (and the spread of a hash), whatever the corpus.
    return docs.join(F.broadcast(marked), "doc_id").where("text is not null")


def _contexts(batches):
    """(word, hash of the word with its neighbours, doc_id, y) for every word."""
    import pandas as pd

    for b in batches:
        words, around, ids, ys = [], [], [], []
        for doc, text, y in zip(b["doc_id"], b["text"], b["y"], strict=True):
            w = _WORD.findall(text.lower())
            seen = {*zip(["", *w[:-1]], w, [*w[1:], ""], strict=True)}
            words += [x[1] for x in seen]
            around += [zlib.crc32("\0".join(x).encode()) for x in seen]
            ids += [doc] * len(seen)
            ys += [int(y)] * len(seen)
        yield pd.DataFrame({"word": words, "around": around, "doc_id": ids, "y": ys})


def learn_stems(sample: DataFrame) -> tuple[list[str], dict]:
    """Prefixes and words that stand out in toxic documents beyond chance among all
    prefixes tried, each pulled to its most specific form, and the seeds that the
    labels don't contradict.

    A document counts for a word only where it has a context (the word with its two
    neighbours) that no earlier document has, so copies don't count as evidence.
    """
    sizes = {bool(r["y"]): r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return list(INSULTS), {"toxic": n1, "clean": n0}
    kind = sample.schema["doc_id"].dataType.simpleString()
    fresh = (sample.mapInPandas(_contexts, f"word string, around long, doc_id {kind}, y int")
             .groupBy("word", "around").agg(F.min(F.struct("doc_id", "y")).alias("own"))
             .groupBy("word", "own").agg(F.lit(1).alias("one"))
             .groupBy("word").agg(F.sum("own.y").alias("t"), F.sum(1 - F.col("own.y")).alias("c")))
    stems = F.concat(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.least(F.lit(10), F.length("word")))),
                                 lambda k: F.substring(F.col("word"), F.lit(1), k)),
                     F.array(F.concat("word", F.lit("$"))))
    counts = (fresh.select(F.explode(F.array_distinct(stems)).alias("stem"), "t", "c")
              .groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    seeds = [s for w in INSULTS for s in (w, w + "$")]
    lift = (F.col("t") + 0.5) / (n1 + 1.0) / ((F.col("c") + 0.5) / (n0 + 1.0))
    # Bounded by the sample, and only what occurs at least three times more in toxic text.
    rows = counts.where(((F.col("t") >= 5) & (lift >= 3)) | F.col("stem").isin(seeds)).collect()
    t, c = {r["stem"]: r["t"] for r in rows}, {r["stem"]: r["c"] for r in rows}
    base = n1 / (n1 + n0)
    tried = math.log(2e5) + 4

    def evidence(s: str) -> float:
        n, k = t[s] + c[s], t[s]
        if not n or k / n <= base:  # none for what clean documents hold as often
            return 0.0
        p = min(k / n, 1 - 1e-9)
        return k * math.log(p / base) + ((n - k) * math.log((1 - p) / (1 - base)) if n > k else 0)

    def lifted(s: str) -> float:
        return (t[s] + 0.5) / (n1 + 1) / ((c[s] + 0.5) / (n0 + 1))

    longer: dict[str, list[str]] = {}
    for s in t:
        longer.setdefault(s[:-1], []).append(s)
    picked: list[str] = []
    for s in sorted((s for s in t if lifted(s) >= 30 and evidence(s) > tried), key=lambda s: (len(s), s)):
        if any(s.startswith(p) for p in picked):
            continue
        while more := [x for x in longer.get(s, []) if t[x] >= 0.9 * t[s]]:
            s = max(more, key=lambda x: (t[x], x))
        if s not in picked:
            picked.append(s)
    kept = [w for w in INSULTS if t.get(w, 0) + c.get(w, 0) < 10 or lifted(w) >= 3]
    return sorted({*kept, *picked}), {"toxic": n1, "clean": n0, "learnt": picked}


def fit_weights(rows: list[tuple[tuple[int, ...], int, int]], steps: int = 50):
    """(weights, matched, base): logistic regression on (features, label, count) by
    Newton's method, held towards the grammar's own weights."""
    if not rows:
        return PRIOR, PRIOR_MATCHED, PRIOR_BASE
    x = np.array([[*f, float(any(f)), float(not any(f))] for f, _, _ in rows])
    y, n = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    prior = np.array([*PRIOR, PRIOR_MATCHED, PRIOR_BASE])
    w, pull = prior.copy(), np.diag([PRIOR_STRENGTH] * len(prior))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + pull @ (w - prior)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w[:-2]), float(w[-2]), float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Grammar:
    """A grammar fitted to the labels of the training fold of (doc_id, text)."""
    sample = materialise(labelled_sample(docs, labels, label_col, sample_rows))
    stems, notes = learn_stems(sample)
    seeded = Grammar(stems=tuple(stems))

    def count(batches):
        import pandas as pd

        m, seen = Matcher(seeded), {}
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                key = (*features([k for *_, k in m.clauses(text)]), int(y))
                seen[key] = seen.get(key, 0) + 1
        yield pd.DataFrame([(*k, v) for k, v in seen.items()], columns=[*MARKS, "y", "n"])

    schema = ", ".join(f"{m} int" for m in MARKS) + ", y int, n long"
    # Distinct tuples of six small logarithms.
    got = sample.mapInPandas(count, schema).groupBy(*MARKS, "y").agg(F.sum("n").alias("n")).collect()
    return Grammar(tuple(stems), *fit_weights([(tuple(r[m] for m in MARKS), r["y"], r["n"]) for r in got]), notes)


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, clauses): one row per row of docs."""
    def run(batches):
        import pyarrow as pa

        m = Matcher(grammar)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marks", pa.int32())])
        for b in batches:
            found = [m.clauses(t) for t in b.column(1).to_pylist()]
            scores = [score_of(grammar, [k for *_, k in f]) for f in found]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([[{"start": s, "end": e, "marks": k} for s, e, k in f] for f in found], pa.list_(span)),
            ], ["doc_id", "score", "predicted", "clauses"])

    docs = two_columns(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double, predicted int, "
                                "clauses array<struct<start: bigint, end: bigint, marks: int>>")


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold."""
    def keep():
        m = Matcher(grammar)
        return lambda texts: [score_of(grammar, [k for *_, k in m.clauses(t)]) < threshold for t in texts.to_pylist()]
    return filter_rows(docs, text_col, keep)


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = two_columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    grammar = learn(docs, table(spark, sf_dir, "labels"))
    return (score_toxicity(docs, grammar)
            .select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("clauses").alias("n_clauses")))
