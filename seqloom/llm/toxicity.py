"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and the context of each hit.

The lexicon holds words and stems (a stem fits every longer word that begins with it; words stay in the lexicon beside their stem). A few seed terms are fixed; the rest is
learned from labelled documents by a likelihood-ratio test with a Bonferroni-like level. Words, and the beginnings
that stems ask for, are matched within one edit (from 5 letters) or two (from 9). The trie's nodes with their edits so far are the states of a nondeterministic automaton;
its deterministic form is built lazily, state by state, so a word that resembles no term dies within a few letters.
Near spellings that occur in clean labelled documents are taken for words of their own.

Around each hit a window of words tells quotation (quotation marks around it, or verbs of saying) from address (second person).
Sums over the document's hits go into a logistic regression. Texts without hits, null and empty texts among them, get its value
at zero. Repeated rows are scored one by one. With no labels of both kinds, fixed weights of the seed terms are used.

Learning uses about SAMPLE_ROWS labelled ids, chosen by a hash of the id, less near copies: rows of one label that share their first
two min-hashes and three quarters of SKETCH. An id with several labels counts as toxic if one says so; of several texts of an id, and of texts
with the same min-hashes, that with the least hash is learned from, so the layout of the rows has no bearing. The model
has at most MAX_TERMS learned terms, the surest; a warning tells if there are more.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WORD_GAP, bounded_batches, crc_of_id, free_name, materialize, table, without

#: Fixed seed terms, fixed verbs of saying and fixed forms of address.
SEEDS = "idiot moron stupid pathetic worthless disgusting loser scum trash clown imbecile bastard".split()
SAYING = frozenset("said says say wrote writes called calls quote quoted quotes word words term terms dit écrit mot sagte sagt schrieb wort dijo dice escribió palabra".split())
ADDRESS = frozenset("you your you're youre yours du dich dir dein ihr tu te toi vous votre tú ti usted eres".split())
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"
LEET = str.maketrans("0134578@$", "oieastbas")
SAMPLE_ROWS = 20_000
WINDOW = 6
MIN_DOCS = 4
MAX_TERMS = 2_000
REMEMBERED = 200_000
#: Min-hashes of a text's words.
SKETCH = 16
#: Lengths of stems.
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")
#: Marks at a token's ends: all but those that may stand for letters, and all.
_ENDS, _ALL_ENDS = (re.compile(rf"^(?:{m}|_)+|(?:{m}|_)+$") for m in (r"[^\w@$]", r"\W"))


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class TrieAutomaton:
    """Lexicon trie x Levenshtein automaton, made deterministic on demand."""

    def __init__(self, words: list[str], stems: list[str], edit_stems: bool = False) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # edits allowed to any term below a node
        self.word_at: dict[int, int] = {}
        self.stem_at: dict[int, int] = {}
        self.allowed = [edits_allowed(w) for w in words] + [edits_allowed(s) if edit_stems else 0 for s in stems]
        for n, term in enumerate([*words, *stems]):
            at = 0
            self.most[0] = max(self.most[0], self.allowed[n])
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], self.allowed[n])
            (self.word_at if n < len(words) else self.stem_at)[at] = n
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self._intern({(0, 0)})

    def _intern(self, positions: set[tuple[int, int]]) -> int:
        """Closes over letters that the text leaves out; (-1 - term, e) says that a stem has been read with e edits."""
        todo = list(positions)
        while todo:
            node, e = todo.pop()
            if node >= 0:
                for child in self.children[node].values():
                    if e < self.most[child] and (p := (child, e + 1)) not in positions:
                        positions.add(p)
                        todo.append(p)
        best: dict[int, int] = {}
        for node, e in positions:
            best[node] = min(e, best.get(node, 99))
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.step.append({})
        return self.number[key]

    def _next(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, e in self.states[state]:
            if node < 0:
                out.add((node, e))
                continue
            if node in self.stem_at and e <= self.allowed[self.stem_at[node]]:
                out.add((-1 - self.stem_at[node], e))
            if e < self.most[node]:
                out.add((node, e + 1))
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, e))
                elif e < self.most[child]:
                    out.add((child, e + 1))
        return self._intern(out)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, or None."""
        if len(self.states) > 100_000:
            self._forget()
        state = 0
        for c in word:
            after = self.step[state].get(c)
            if after is None:
                after = self.step[state][c] = self._next(state, c)
            state = after
            if not self.states[state]:
                return None
        found = [(e, self.word_at[n]) for n, e in self.states[state] if n in self.word_at and e <= self.allowed[self.word_at[n]]]
        found += [(e, -1 - n) for n, e in self.states[state] if n < 0]
        return min(found)[::-1] if found else None


N_FEATURES = 6


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float]
    benign: frozenset = frozenset()
    coefficients: list[float] = field(default_factory=lambda: [2.0, 0.3, 1.0, 0.5, 0.5, 0.5])
    bias: float = -2.5

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _ready(self) -> None:
        if "_automaton" not in self.__dict__:
            self._automaton = TrieAutomaton(self.words, self.stems, edit_stems=True)
            self._clean: set[str] = set()
            self._hits: dict[str, list[tuple[int, int]]] = {}

    def _match(self, word: str) -> tuple[int, int] | None:
        hit = self._automaton.match(word) if len(word) > 2 else None
        return None if hit is None or (hit[1] and word in self.benign) else hit

    def _classify(self, token: str) -> None:
        """The token less its marks, signs read as letters; if that isn't a term without edits, its runs of letters if they come nearer."""
        core = _ENDS.sub("", token)
        if core.isalpha():
            hit = self._match(core)
            hits = [hit] if hit else []
        elif any(c.isalpha() for c in core):
            whole = [hit for form in dict.fromkeys((core, _ALL_ENDS.sub("", core))) if (hit := self._match(form if form.isalpha() else form.translate(LEET)))]
            hits = [min(whole, key=lambda hit: hit[1])] if whole else []
            if not hits or hits[0][1]:
                runs = [hit for run in _WORD.findall(core) if (hit := self._match(run))]
                if runs and (not hits or min(e for _, e in runs) < hits[0][1]):
                    hits = runs
        else:
            hits = []
        if hits:
            self._hits[token] = hits
        else:
            self._clean.add(token)

    def features(self, text: str) -> list[float]:
        """Weights of hits: terms outside quotation, any in quotation, near spellings; then of the first kind: different terms, share of words, hits in address."""
        self._ready()
        tokens = text.lower().split()
        different = set(tokens)
        if len(self._clean) + len(self._hits) > REMEMBERED:
            self._clean, self._hits = set(), {}
        new = different - self._clean - self._hits.keys()
        for t in new:
            self._classify(t)
        found = different & self._hits.keys()
        if not found:
            return [0.0] * N_FEATURES
        plain = quoted = near = 0.0
        terms, addressed, hits = set(), 0, 0
        for i, t in enumerate(tokens):
            if t not in found:
                continue
            before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
            in_quotes = any(x[0] in OPENING for x in before) and any(x.rstrip(".,;:!?")[-1:] in CLOSING for x in after if x.rstrip(".,;:!?"))
            said = in_quotes or not SAYING.isdisjoint(before) or not SAYING.isdisjoint(after)
            for term, edits in self._hits[t]:
                w = self.weights[term]
                if said:
                    quoted += w
                elif edits:
                    near += w / edits
                else:
                    plain += w
                    addressed += not ADDRESS.isdisjoint(before) or not ADDRESS.isdisjoint(after)
                    terms.add(term)
                    hits += 1
        return [math.log1p(plain), math.log1p(quoted), math.log1p(near), math.log1p(len(terms)), math.log1p(100 * hits / len(tokens)), math.log1p(addressed)]

    def score(self, text: str) -> float:
        z = self.bias + sum(a * b for a, b in zip(self.coefficients, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _keys(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if len(w) > 2}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pos: Counter = Counter()
    neg: Counter = Counter()

    def out():
        keys = list(pos.keys() | neg.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["key", "pos", "neg"])

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            (pos if toxic else neg).update(_keys(text))
        if len(pos) + len(neg) > 300_000:
            yield from out()
            pos.clear()
            neg.clear()
    yield from out()


def _g2(p: int, q: int, n_pos: int, n_neg: int) -> float:
    def part(k: int, n: int, rate: float) -> float:
        return sum(o * math.log(o / e) for o, e in ((k, n * rate), (n - k, n * (1 - rate))) if o)

    rate = (p + q) / (n_pos + n_neg)
    return 2 * (part(p, n_pos, rate) + part(q, n_neg, rate)) if 0 < rate < 1 else 0.0


def choose_terms(counts: list[tuple[str, int, int]], n_pos: int, n_neg: int) -> tuple[list[str], list[str], dict[str, float]]:
    """(words, stems, weight of each) from (key, toxic documents, clean documents)."""
    weight = {k: math.log((p + 0.5) / (n_pos + 1)) - math.log((q + 0.5) / (n_neg + 1)) for k, p, q in counts}
    level = 2 * math.log(20 * max(1, len(counts)))
    good = sorted(((_g2(p, q, n_pos, n_neg), -len(k), k, p) for k, p, q in counts if weight[k] > 2), reverse=True)
    longest: dict[str, int] = {}
    for k, p, _ in counts:
        if k[-1] != "*":
            for n in STEMS:
                longest[k[:n]] = max(p, longest.get(k[:n], 0))
    words, stems, under = [], [], 0
    for g, _, k, p in good:
        if g < level:
            break
        if len(words) - under + len(stems) >= MAX_TERMS:
            warnings.warn(f"there are more than {MAX_TERMS} terms; only the surest are used", stacklevel=2)
            break
        above = any(k.startswith(s) for s in stems)
        if k[-1] != "*":  # beside a stem too, which does not fit the word that equals it and allows fewer edits; such words take no other term's place
            words.append(k)
            under += above
        elif not above and p > 1.3 * longest.get(k[:-1], 0):
            stems.append(k[:-1])
    return words, stems, weight


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method; the bias is not shrunk."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    shrink = np.diag([l2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def near_copies(rows: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Those of the different (label, sketch) that share the first two hashes and three quarters of all with an earlier one, in order, that stays."""
    groups: dict[tuple[int, int, int], list[list[int]]] = {}
    for toxic, m in sorted(rows):
        groups.setdefault((toxic, m[0], m[1]), []).append(m)
    out = []
    for (toxic, _, _), sketches in groups.items():
        if len(sketches) > 1:
            stay, n = np.empty((len(sketches), SKETCH), np.int64), 0
            for m in sketches:
                if n and (4 * (stay[:n] == np.array(m, np.int64)).sum(1) >= 3 * SKETCH).any():
                    out.append((toxic, m))
                else:
                    stay[n] = m
                    n += 1
    return out


def less_near_copies(sample: DataFrame) -> DataFrame:
    """sample(text, toxic) with one of near copies; as many sketches as the sample has rows go to the driver."""
    sample = sample.withColumn("words", F.array_distinct(F.split(F.lower("text"), WORD_GAP)))
    # a function of the word alone: a second argument of it would be the word's place
    least = lambda k: F.array_min(F.transform("words", lambda w: F.xxhash64(w, F.lit(k))))
    sketch = F.array(*[least(k) for k in range(SKETCH)])
    sample = materialize(sample.select("text", "toxic", sketch.alias("m")).groupBy("toxic", "m").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic-sample")
    dropped = near_copies([(r["toxic"], r["m"]) for r in sample.select("toxic", "m").collect()])
    if dropped:
        sample = sample.join(F.broadcast(sample.sparkSession.createDataFrame(dropped, "toxic int, m array<long>")), ["toxic", "m"], "left_anti")
    return sample.select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labels(doc_id, toxic) of the documents where learn_from holds; it sees the id as doc_id."""
    bounded_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(learn_from) if learn_from is not None else marked
    n = marked.count()
    share = min(1.0, sample_rows / max(1, n))
    marked = marked.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) < int(share * 2**32)).withColumnRenamed("doc_id", "__id")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    # about sample_rows rows of two numbers
    sample = docs.select(F.col(f"`{id_col}`").alias("__id"), text).join(F.broadcast(marked), "__id")
    sample = sample.groupBy("__id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")
    # of near copies one stays, told by many least hashes of their words: else a copied document's words would all look toxic
    sample = less_near_copies(sample)
    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_pos, n_neg = size.get(1, 0), size.get(0, 0)
    if not n_pos or not n_neg:
        return Model(SEEDS, [], [3.0] * len(SEEDS))
    counts = materialize(sample.mapInArrow(_count, "key string, pos long, neg long").groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-counts")
    strong = counts.where((F.col("pos") >= MIN_DOCS) & (F.col("pos") * n_neg > 5 * F.col("neg") * n_pos) | F.col("key").isin(SEEDS))
    found = [tuple(r) for r in strong.orderBy(F.desc("pos"), "key").collect()]  # keys of a bounded sample
    words, stems, weight = choose_terms(found, n_pos, n_neg)
    words = [*dict.fromkeys([*words, *(s for s in SEEDS if weight.get(s, 1) > 0)])]
    model = Model(words, stems, [max(0.5, weight.get(k, 3.0)) for k in [*words, *(s + "*" for s in stems)]])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model._ready()
        for b in batches:
            yield b.filter(pa.array([bool((m := model._automaton.match(k)) and m[1]) for k in b.column(0).to_pylist()], pa.bool_()))

    alike = counts.where(~F.col("key").endswith("*") & (4 * F.col("neg") * n_pos > F.col("pos") * n_neg)).mapInArrow(near, counts.schema)
    model.benign = frozenset(r["key"] for r in alike.select("key").collect())
    model.__dict__ = model.__getstate__()
    rows = sample.mapInArrow(_features(model), "x array<double>, toxic int").collect()
    w, b = fit_logistic(np.array([r["x"] for r in rows]), np.array([float(r["toxic"]) for r in rows]))
    model.coefficients, model.bias = [float(v) for v in w], b
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with the score of each whole text."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([model.score(t or "") for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], s], [*b.schema.names[:-1], out_col])

    kept = without(df, out_col)
    text = F.col(f"`{text_col}`").alias(free_name(kept.columns, "text_to_score"))
    return df.select(*[F.col(f"`{c}`") for c in kept.columns], text).mapInArrow(run, StructType([*kept.schema.fields, StructField(out_col, DoubleType())]))


def learnable() -> Column:
    return F.pmod(crc_of_id("doc_id"), F.lit(5)) != 0


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less those that a model learned from labels scores 0.5 or more."""
    name = free_name(docs.columns, "toxic_score")
    scored = score(docs, train(docs, labels, learnable()), out_col=name)
    return scored.where(F.col(name) < 0.5).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), learnable()))
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
