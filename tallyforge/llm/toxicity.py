"""Toxicity by a weighted finite-state pattern grammar.

Transducers read a text, each the output of the one before:

* *words* - a weighted trie over letters, induced from labelled rows: beginnings and whole
  words that mark toxic documents, each with its log odds as weight. It turns every word
  into a symbol: insult, threat, target, negation, reported speech, other, or a clause's end;
* *negation* - reaches a few words ahead and turns an insult into a negated one;
* *reported* - a reporting word covers its clause, or the next one if it ends its own;
* *target* - guesses at a clause's beginning whether a target will come; a wrong guess dies
  at the clause's end, so insults are known as targeted ones wherever the target stands.

``compose`` joins the last three into one machine over the words' symbols. Targets and
reporting words are a closed list plus words that labelled rows show beside insults of
toxic and of clean documents. A matched clause adds its weights to the grammar's channels
(plain, targeted, negated, reported, threatening); the channels' own weights are fitted on
labelled rows that the trie did not see. Words outside matched clauses score nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, spread, stratified_rows

#: Bound of the labelled sample in rows, shared evenly by the labels; each is read whole.
SAMPLE_ROWS = 3000
MIN_SUPPORT = 4
MIN_WEIGHT = 1.5
#: A word beside insults is learned as a target (or as reported speech) from these log odds on (or down).
MIN_CONTEXT = 1.0

# fixed values: the closed word lists of the grammar
TARGET = frozenset("you your yours yourself u he she him her they them du dich dir ihr euch dein deine sie tu toi te vous votre ton ta il elle ils usted ustedes tú vos vosotros él ella ellos".split())
THREAT = frozenset("kill hurt destroy burn beat smash punish shoot stab hang hunt töten umbringen schlagen vernichten verbrennen erschießen tuer frapper détruire brûler matar golpear destruir quemar".split())
NEGATION = frozenset("not never nobody isn't aren't wasn't don't doesn't nicht kein keine niemals nie jamais aucun nunca jamás ningún".split())
REPORTED = frozenset("said says say called calls wrote quote quoted according sagte sagt nannte schrieb laut dit écrit selon appelé dijo dice llamó escribió según".split())
NEGATION_REACH = 3

_WORD = re.compile(r"\w+(?:'\w+)?|[.!?;\n]+")
_WORDS_ONLY = re.compile(r"\w+(?:'\w+)?")
N_FEATURES = 9
#: Symbols of a text: insult, threat, target, negation, reported speech, other, end of a clause.
SYMBOLS = "IHTNRO."


class Transducer:
    """arcs[state][symbol] -> (output, next state) pairs; starts in ``start``. Output O is silent."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def compose(self, other: Transducer) -> Transducer:
        """Reads what this reads, writes what the other writes of this one's output; reachable states only."""
        start = (self.start, other.start)
        arcs: dict = {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            arcs[state] = {}
            for symbol, steps in self.arcs[state[0]].items():
                found = [(out, (to, to2)) for mid, to in steps for out, to2 in other.arcs[state[1]].get(mid, ())]
                if found:
                    arcs[state][symbol] = found
                    todo += [to for _, to in found]
        return Transducer(start, arcs)

    def run(self, symbols: list[str]) -> list[str]:
        """The output of the one path that survives; every text ends with a clause's end."""
        alive, done = {self.start: []}, []
        for symbol in symbols:
            nexts: dict = {}
            for state, out in alive.items():
                for written, to in self.arcs[state].get(symbol, ()):
                    nexts[to] = [*out, written]
            alive = nexts
            if len(alive) == 1:
                [(state, out)] = alive.items()
                done += out
                alive = {state: []}
        return done


def negation(reach: int = NEGATION_REACH) -> Transducer:
    """n: an insult within ``reach`` words after a negation; a negated threat is none."""
    arcs = {}
    for s in range(reach + 1):
        down = max(0, s - 1)
        arcs[s] = {x: [(x, down)] for x in "TRO"} | {"N": [("O", reach)], ".": [(".", 0)], "I": [("n" if s else "I", down)], "H": [("O" if s else "H", down)]}
    return Transducer(0, arcs)


def reported() -> Transducer:
    """r: an insult in a clause with a reporting word, or in the one after a clause that ends with it."""
    arcs = {}
    for s, covered in (("open", False), ("covered", True), ("said", True)):
        on = "covered" if covered else "open"
        arcs[s] = {x: [(x, on)] for x in "TOn"} | {"R": [("O", "said")], ".": [(".", "covered" if s == "said" else "open")], "I": [("r" if covered else "I", on)], "H": [("O" if covered else "H", on)]}
    return Transducer("open", arcs)


def target() -> Transducer:
    """i and h: an insult and a threat in a clause with a target; p: an insult in one without."""
    same = lambda to: {x: [(x, to)] for x in "Onr"}
    arcs = {
        "none": same("none") | {"I": [("p", "none")], "H": [("O", "none")], ".": [(".", "begin")]},
        "awaited": same("awaited") | {"I": [("i", "awaited")], "H": [("h", "awaited")], "T": [("O", "met")]},
        "met": same("met") | {"I": [("i", "met")], "H": [("h", "met")], "T": [("O", "met")], ".": [(".", "begin")]},
    }
    arcs["begin"] = {x: arcs["none"].get(x, []) + arcs["awaited"].get(x, []) for x in "OnrIHT."}
    return Transducer("begin", arcs)


CLAUSES = negation().compose(reported()).compose(target())


def induce_trie(texts: list[str], labels: list[int]) -> dict[str, float]:
    """Beginning -> weight. A trailing $ marks a whole word. Of beginnings with the same support the longest is kept.

    Letter by letter: a beginning is followed only while enough toxic documents hold it, so
    words of any length cost no more than their frequent beginnings.
    """
    docs: tuple[list, list] = ([], [])
    one: dict[str, str] = {}  # each word is held once
    for text, y in zip(texts, labels):
        docs[y].append({one.setdefault(w, w) for w in _WORDS_ONLY.findall(text.lower())})
    totals = [1 + len(d) for d in docs]
    open_docs, counts, size = [list(d) for d in docs], (Counter(), Counter()), 0
    while any(open_docs[1]):
        size += 1
        level = (Counter(), Counter())
        for words in open_docs[1]:
            level[1].update({w[:size] for w in words} | {w + "$" for w in words if len(w) == size})
        frequent = {b for b, n in level[1].items() if n >= MIN_SUPPORT}
        for words in open_docs[0]:
            level[0].update(({w[:size] for w in words} | {w + "$" for w in words if len(w) == size}) & frequent)
        for y in (0, 1):
            counts[y].update({b: n for b, n in level[y].items() if b in frequent})
            open_docs[y] = [{w for w in words if len(w) > size and w[:size] in frequent} for words in open_docs[y]]
    found: dict[str, float] = {}
    for b, n in counts[1].items():
        weight = math.log((n + 0.1) / totals[1]) - math.log((counts[0][b] + 0.5) / totals[0])
        if weight >= MIN_WEIGHT and len(b) > 1:
            found[b] = weight
    longest = {}
    for b in sorted(found, key=len):
        stem = b.rstrip("$")
        longest[b] = found[b]
        for k in range(2, len(stem) + (b[-1] == "$")):
            short = stem[:k]
            if short in longest and counts[1][short] <= 1.05 * counts[1][b] and counts[0][short] >= counts[0][b]:
                del longest[short]
    return longest


class Words:
    """The first transducer: letters of a word -> (symbol, weight), along the arcs of a trie."""

    def __init__(self, trie: dict[str, float], roles: dict[str, str]):
        self.trie, self.roles = trie, roles
        self.arcs: dict[str, dict[str, float | None]] = defaultdict(dict)
        for b, weight in trie.items():
            for k in range(1, len(b)):
                self.arcs[b[: k - 1]].setdefault(b[k - 1], None)
            self.arcs[b[:-1]][b[-1]] = weight
        self.known: dict[str, tuple[str, float]] = {}

    def read(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 400_000:
                self.known.clear()
            found = self.known[word] = self._read(word)
        return found

    def _read(self, word: str) -> tuple[str, float]:
        best = 0.0
        for k, letter in enumerate(word):
            arcs = self.arcs.get(word[:k])
            if not arcs or letter not in arcs:
                break
            best = max(best, arcs[letter] or 0.0)
        else:
            best = max(best, self.arcs.get(word, {}).get("$") or 0.0)
        return ("I", best) if best else (self.roles.get(word, "O"), 0.0)


def closed_roles() -> dict[str, str]:
    return {w: symbol for symbol, words in (("R", REPORTED), ("N", NEGATION), ("T", TARGET), ("H", THREAT)) for w in words}


def learn_roles(words: Words, texts: list[str], labels: list[int]) -> dict[str, str]:
    """The closed lists, plus words of clauses with an insult: those of toxic documents as targets, those of clean ones as reported speech."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    totals = [1, 1]
    for text, y in zip(texts, labels):
        for clause in re.split(r"[.!?;\n]+", text.lower()):
            held = set(_WORDS_ONLY.findall(clause))
            insults = {w for w in held if words.read(w)[0] == "I"}
            if insults:
                counts[y].update(held - insults)
                totals[y] += 1
    roles = closed_roles()
    for w in counts[0].keys() | counts[1].keys():
        if w not in roles:
            toxic, clean = counts[1][w] + 0.5, counts[0][w] + 0.5
            odds = math.log(toxic / totals[1]) - math.log(clean / totals[0])
            if abs(odds) >= max(MIN_CONTEXT, 4 * math.sqrt(1 / toxic + 1 / clean)):  # four standard errors: many words are tried
                roles[w] = "T" if odds > 0 else "R"
    return roles


class Grammar:
    """The composed machine over the words' symbols; ``features`` reads one text."""

    def __init__(self, trie: dict[str, float], roles: dict[str, str]):
        self.words = Words(trie, roles)

    def features(self, text: str | None) -> list[float]:
        text = (text or "").lower()
        read = self.words.read
        tokens = _WORD.findall(text)
        found = [(".", 0.0) if t[0] in ".!?;\n" else read(t) for t in tokens]
        size = sum(symbol != "." for symbol, _ in found)
        if not any(symbol in "IH" for symbol, _ in found):
            return [0.0] * (N_FEATURES - 1) + [math.log1p(size)]
        sums = dict.fromkeys("pinrh", 0.0)
        weights = [w for _, w in found if w]
        written = CLAUSES.run([symbol for symbol, _ in found] + ["."])
        at = iter(weights)
        for out in written:
            if out in "pinr":
                sums[out] += next(at)
            elif out == "h":
                sums["h"] += 1
        total = sum(weights)
        return [*(math.log1p(sums[c]) for c in "pinrh"), max(weights, default=0.0), math.log1p(len(weights)), total / math.sqrt(1 + size), math.log1p(size)]


class Model:
    """Grammar plus fitted channel weights; ``score`` is a probability."""

    def __init__(self, grammar: Grammar, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.grammar, self.mean, self.scale, self.weights = grammar, mean, scale, weights

    def score(self, text: str | None) -> float:
        x = (np.array(self.grammar.features(text)) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ self.weights[:-1] + self.weights[-1]))))))


def fit(texts: list[str], labels: list[int]) -> Model:
    """Trie and roles on two thirds of the rows, channel weights on the rest (all rows if those lack a label).

    Both labels weigh alike in the fit, so 0.5 divides them whatever their shares.
    """
    third = [k % 3 == 0 for k in range(len(texts))]
    pick = lambda keep: ([t for t, x in zip(texts, third) if x == keep], [y for y, x in zip(labels, third) if x == keep])
    a, b = pick(False), pick(True)
    if len(set(b[1])) < 2 or len(set(a[1])) < 2:
        a = b = (texts, labels)
    trie = induce_trie(*a)
    grammar = Grammar(trie, learn_roles(Words(trie, {}), *a))
    x = np.array([grammar.features(t) for t in b[0]], dtype=float).reshape(-1, N_FEATURES)
    y = np.array(b[1], dtype=float)
    if len(set(b[1])) < 2:  # nothing to tell apart: the base rate, or 0 without rows
        base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(grammar, np.zeros(N_FEATURES), np.ones(N_FEATURES), np.append(np.zeros(N_FEATURES), math.log(base / (1 - base))))
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(N_FEATURES + 1)
    ridge = np.append(np.full(N_FEATURES, 1e-2 * len(z) / 100), 1e-6)
    for _ in range(50):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (share * p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(ridge), z.T @ (share * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(grammar, mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> Model:
    """Fits on a bounded, hash-chosen sample of labelled rows outside the held-out fold; labels that are null or not 0/1 are ignored.

    The ids are chosen from the labels, half of each, then their texts are read in one scan.
    Of documents that share an id, as many are taken as the bound allows.
    """
    marks = labels.where(F.col(label_col).isin(0, 1)).where(fold_of(id_col, folds) != held_out)
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = stratified_rows(marks, "id", "y", rows)
    if not chosen:
        return fit([], [])
    spark = docs.sparkSession
    wanted = spark.createDataFrame([tuple(r) for r in chosen], T.StructType([T.StructField("id", labels.schema[id_col].dataType), T.StructField("y", T.IntegerType())]))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    got = texts.join(F.broadcast(wanted), "id").orderBy(F.xxhash64(F.col("id").cast("string")), "id", "text").limit(rows).collect()  # at most ``rows``
    return fit([r.text for r in got], [r.y for r in got])


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """id (and the ``keep`` columns), score in 0..1 and predicted (1 from ``threshold`` on) for every row.

    Null and empty texts are scored as texts without words; whole texts are read; null and
    repeated ids keep their rows.
    """
    names = [id_col, *[c for c in (keep or []) if c != id_col]]
    inner = [f"c{k}" for k in range(len(names))]  # the caller's names cannot clash with those used here
    fields = [T.StructField(i, docs.schema[c].dataType) for c, i in zip(names, inner)]
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(names, inner)], F.col(text_col).cast("string").alias("text"))
    parts = ((model.grammar.words.trie, model.grammar.words.roles), model.mean, model.scale, model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(Grammar(*parts[0]), *parts[1:])
        for b in batches:
            scores = [here.score(t) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [*inner, "score", "predicted"])

    out = spread(rows).mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
    return out.toDF(*names, "score", "predicted")
