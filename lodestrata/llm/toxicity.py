"""Toxicity: misspelled terms of a learned lexicon, scored by what stands around them.

Terms are words that labelled toxic documents hold more often than the rest, by a likelihood-ratio test over the whole
vocabulary of the sample. Words of the corpus are matched against the trie of the terms by their Levenshtein automata: a walk
down the trie that carries, for all words of a batch at once, the automaton's states as bits (one word of bits for each number
of errors), and leaves a branch once no state of a word is alive. A near word counts by how likely it is a term misspelled
rather than a word of its own: a word that the sample holds, by its own documents; an unseen one, by the share of misspellings
and by the once-seen clean words that lie as near to the term.

Around each match a window of words tells quotation (marks that open before and close after it, words of reporting) from abuse.
A logistic model of the document, fitted to the labels with Gaussian priors, weighs the strongest match and the sums of matches
outside and inside of quotations.

The sample is bounded by SAMPLE labelled rows (in expectation, by a hash of the id), of which near copies count once; all else
sees every document whole. Fitted numbers (the lexicon of at most TERMS terms, and the sample's words near to them) are broadcast.

Defined cases: a null or empty text, and one without a match, has the score of documents without matches; labels that are null
or of unknown documents are not learned from; a document labelled more than once counts as toxic if one label says so; without
labelled documents all scores are 0; null ids are never held out; repeated rows are scored alike; words of any length pass, and
very long texts are read in pieces that end between words; an empty table gives an empty table. All other columns pass through,
whatever their names (but for those that begin with two underscores).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_arrow, slabs, strings, text_or_empty
from .langid import held_out

#: Labelled rows that are learned from, and terms of the lexicon.
SAMPLE, TERMS = 10_000, 4096
#: Code points of terms; those of at least TWO_ERRORS may have two errors, others one.
SHORTEST, TWO_ERRORS, LONGEST = 4, 6, 40
#: Share of a term's places that are misspelled with one and with two errors.
MISSPELT = (0.0, 0.02, 0.005)
#: Words on each side of a match that tell its context.
WINDOW = 12
#: Code points of a text that are split into words at a time, and words that a worker remembers.
PIECE, KNOWN = 1 << 20, 500_000
#: Least weight (a logarithm of odds against the sample's) of a match that counts, and places of a near word that its term's rate is worth.
LEAST, WORTH = 1.5, 5
#: Words that report what others say.
REPORTS = frozenset("said says called calls wrote word words term quote quoted phrase sagte nannte wort begriff zitat dit appelle mot terme cite dijo llama palabra termino cita".split())
OPENS, CLOSES = "\"'“„«‘‹「", "\"'”“»’›」"
_CLOSES = frozenset(CLOSES)
LOOKALIKES = str.maketrans("0134578@$!|", "oieastbasil")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_PARTS = re.compile(r"[^\W_]+")
_RUNS = re.compile(r"(.)\1{2,}")


def spellings(token: str) -> list[str]:
    """What a lower-case token may spell: without its edges, digits and signs that look like letters being letters; and its parts."""
    found = _EDGES.sub("", token)
    if not found or found.isalpha():
        return [_RUNS.sub(r"\1", found)] if SHORTEST - 2 <= len(found) else []
    parts = _PARTS.findall(found)
    out = parts if len(parts) > 1 else []
    if sum(map(str.isalpha, found[: 2 * LONGEST])) >= 2:
        out = [*out, found.translate(LOOKALIKES)]
    return [_RUNS.sub(r"\1", x) for x in out if SHORTEST - 2 <= len(x)]


def words_of(text: str) -> set[str]:
    """All spellings in a text."""
    return {s for token in set(text.lower().split()) for s in spellings(token)}


class Trie:
    """The terms, and the intersection of their trie with the Levenshtein automata of words."""

    def __init__(self, terms: list[str], most: list[int] | None = None) -> None:
        """most: errors that each term allows, 2 or 1 by its length if not given; -1 leaves it out."""
        self.terms = terms
        self.most = most or [2 if len(t) >= TWO_ERRORS else 1 for t in terms]
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        for k, term in enumerate(terms):
            at = 0
            for c in term if self.most[k] >= 0 else "":
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                at = self.kids[at][c]
            self.ends[at] = k if at else -1
        #: errors that any term below a node allows
        self.below = [0] * len(self.kids)
        for k in range(len(self.kids) - 1, -1, -1):
            own = self.most[self.ends[k]] if self.ends[k] >= 0 else 0
            self.below[k] = max([own, *(self.below[x] for x in self.kids[k].values())])

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, int, int]]:
        """(numbers of words, term, errors) for each term and each number of errors that it allows."""
        lengths = np.array([len(w) for w in words])
        use = np.flatnonzero((lengths >= SHORTEST - 2) & (lengths <= LONGEST + 2))
        if not len(use) or not self.terms:
            return
        lengths = lengths[use]
        wide = int(lengths.max())
        codes = np.frombuffer("".join(words[i].ljust(wide, "\0") for i in use.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(use), wide)
        columns = np.ascontiguousarray(codes.T)
        places: dict[str, np.ndarray] = {}

        def where(c: str) -> np.ndarray:
            """Bit j: whether the word has c at j."""
            if c not in places:
                found = np.zeros(len(use), np.uint64)
                for j in range(wide):
                    found |= (columns[j] == ord(c)).astype(np.uint64) << np.uint64(j)
                places[c] = found
            return places[c]

        one = np.uint64(1)
        full = (one << (lengths + 1).astype(np.uint64)) - one
        last = lengths.astype(np.uint64)
        stack = [(0, np.arange(len(use)), [np.full(len(use), (1 << (d + 1)) - 1, np.uint64) & full for d in range(3)])]
        while stack:
            node, who, states = stack.pop()
            for c, kid in self.kids[node].items():
                here, mask = where(c)[who], full[who]
                after = [((states[0] & here) << one) & mask]
                for d in range(1, self.below[kid] + 1):
                    after.append((((states[d] & here) << one) | states[d - 1] | (states[d - 1] << one) | (after[d - 1] << one)) & mask)
                alive = after[-1] != 0
                if not alive.any():
                    continue
                if not alive.all():
                    after = [s[alive] for s in after]
                on = who[alive]
                term = self.ends[kid]
                if term >= 0:
                    ends = [(s >> last[on]) & one != 0 for s in after]
                    for d in range(self.most[term] + 1):
                        hit = ends[d] & ~ends[d - 1] if d else ends[0]
                        if hit.any():
                            yield use[on[hit]], term, d
                if self.kids[kid]:
                    stack.append((kid, on, after))

    def nearest(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest term of each word (of equals the first; -1 if none), and its errors."""
        term, errors = np.full(len(words), len(self.terms)), np.full(len(words), 9)
        for who, t, d in self.near(words):
            better = (d < errors[who]) | ((d == errors[who]) & (t < term[who]))
            term[who[better]], errors[who[better]] = t, d
        return np.where(errors < 9, term, -1), errors


@dataclass
class Model:
    """A fitted model. weights[t][d]: of unseen words with d errors; own: of words that the sample holds."""

    terms: list[str]
    weights: np.ndarray
    own: dict[str, float]
    beta: np.ndarray | None = None
    trie: Trie | None = None
    known: set[str] = field(default_factory=set)
    hot: dict[str, float] = field(default_factory=dict)

    def learn(self, tokens: set[str]) -> None:
        """Weights of tokens that were not met before: positive ones are hot."""
        self.trie = self.trie or Trie(self.terms, [int(np.flatnonzero(w > 0).max(initial=-1)) for w in self.weights])
        new = list(tokens - self.known)
        if not new:
            return
        if len(self.known) > KNOWN:
            self.known, self.hot, new = set(), {}, list(tokens)
        spelt = [(i, s) for i, token in enumerate(new) for s in spellings(token)]
        words = list({s for _, s in spelt})
        term, errors = self.trie.nearest(words)
        value = {w: self.own[w] for w in words if w in self.own}
        for i in np.flatnonzero(term >= 0).tolist():
            value.setdefault(words[i], float(self.weights[term[i], errors[i]]))
        for i, s in spelt:
            if value.get(s, 0.0) > 0:
                self.hot[new[i]] = max(value[s], self.hot.get(new[i], 0.0))
        self.known.update(new)

    def read(self, texts: list[str]) -> Iterator[tuple[list[float], dict[str, float]]]:
        """Features and matching tokens of each text; the tokens of all but very long texts are learned at once."""
        short = [t.lower().split() if len(t) <= PIECE else None for t in texts]
        self.learn(set(chain.from_iterable(t for t in short if t)))
        for text, tokens in zip(texts, short, strict=True):
            yield self.features(pieces(text) if tokens is None else [tokens])

    def features(self, parts: Iterable[list[str]]) -> tuple[list[float], dict[str, float]]:
        """Whether nothing matches, whether something does, strongest match outside of quotations, sums of those outside and
        inside; and the weights of matching tokens."""
        most, plain, quoted, found = 0.0, 0.0, 0.0, {}
        for tokens in parts:
            self.learn(set(tokens))
            if self.hot.keys().isdisjoint(tokens):
                continue
            for i, token in enumerate(tokens):
                w = self.hot.get(token)
                if w is None:
                    continue
                found[token] = w
                share = quotation(tokens, i)
                quoted += w * share
                plain += w * (1 - share)
                most = max(most, w * (1 - share))
        return [float(not found), float(bool(found)), most, math.log1p(plain), math.log1p(quoted)], found

    def score(self, features: list[float]) -> float:
        if self.beta is None:
            return 0.0
        z = float(np.dot(self.beta, features))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def pieces(text: str) -> Iterator[list[str]]:
    """Lower-case tokens, about PIECE code points at a time; windows end with their piece."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        yield text[at:stop].lower().split()
        at = stop


def quotation(tokens: list[str], i: int) -> float:
    """How far a token's window speaks of quotation: 1 within marks, half beside a word of reporting, else 0."""
    before, after = tokens[max(0, i - WINDOW) : i + 1], tokens[i : i + WINDOW + 1]
    opened = closed = False
    for k, token in enumerate(reversed(before)):
        if token[0] in OPENS:
            opened = True
            break
        if k and token.rstrip(".,;:!?)")[-1:] in _CLOSES:
            break
    if opened:
        for k, token in enumerate(after):
            if k and token[0] in OPENS:
                break
            if token.rstrip(".,;:!?)")[-1:] in _CLOSES:
                closed = True
                break
    if opened and closed:
        return 1.0
    return 0.5 if any(_EDGES.sub("", t) in REPORTS for t in tokens[max(0, i - 3) : i + 4]) else 0.0


def _signature(text: str) -> int:
    """The least hash of its five-word shingles: near copies mostly have the same one."""
    w = text.split()
    return min(xxhash.xxh3_64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))) >> 1


def sample(df: DataFrame, labels: DataFrame, text: str, doc: str, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """text, toxic: at most about `rows` labelled documents outside of the fold, near copies with one label once."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull() & ~held_out(doc, folds, fold))
    marked = marked.groupBy(F.col(doc).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("toxic"))
    n = marked.count()
    if n > rows:
        marked = marked.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < int(rows / n * (1 << 40)))
    texts = df.select(F.col(f"`{doc}`").alias("__id"), text_or_empty(f"`{text}`").alias("text"))
    both = texts.join(F.broadcast(marked), "__id").select("text", "toxic")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([_signature(t) for t in strings(batch.column(0))], pa.int64()), *batch.columns], ["sig", "text", "toxic"])

    found = map_arrow(both, signed, "sig bigint, text string, toxic int")
    return cut(found.groupBy("sig", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"))


def _odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def train(
    df: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "toxic", folds: int = 4, fold: int = 2, rows: int = SAMPLE, terms: int = TERMS,
) -> Model:
    """A model from the labelled documents of df outside of the fold (crc32 of the id as text, modulo folds)."""
    texts = sample(df, labels, text, doc, label, folds, fold, rows)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            for t, toxic in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                own = [w for w in words_of(t) if len(w) <= LONGEST + 2]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([toxic] * len(own), pa.int32())], ["word", "toxic"])

    counts = map_arrow(texts, spelt, "word string, toxic int").groupBy("word").agg(F.sum("toxic").cast("long").alias("pos"), F.count(F.lit(1)).alias("n"))
    vocabulary = cut(counts)
    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    p, n = total.get(1, 0), total.get(0, 0)
    if not p + n:
        return Model([], np.zeros((0, 3)), {})
    base = (p + 0.5) / (p + n + 1)
    # likelihood ratio of a word's documents being toxic at their own rate rather than the sample's, against that of all words tried
    tried = vocabulary.filter("n >= 3").count()
    rate = F.col("pos") / F.col("n")
    part = lambda k, q: F.when(k > 0, k * F.log(k / (F.col("n") * q))).otherwise(0.0)
    gain = part(F.col("pos"), base) + part(F.col("n") - F.col("pos"), 1 - base)
    picked = vocabulary.filter((F.col("pos") >= 3) & (F.length("word") >= SHORTEST) & (F.length("word") <= LONGEST) & (rate > base) & (gain > math.log(max(tried, 1)) + 3))
    chosen = picked.withColumn("gain", gain).orderBy(F.desc("gain"), "word").limit(terms).collect()
    names = [r["word"] for r in chosen]
    weight = [min(6.0, _odds((r["pos"] + 0.5) / (r["n"] + 1)) - _odds(base)) for r in chosen]
    at = df.sparkSession.sparkContext.broadcast(names)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(at.value)
        for batch in batches:
            term, errors = trie.nearest(strings(batch.column(0)))
            hit = pa.array((term >= 0) & (errors > 0))
            yield pa.RecordBatch.from_arrays([*(c.filter(hit) for c in batch.columns), pa.array(term, pa.int32()).filter(hit), pa.array(errors, pa.int32()).filter(hit)], ["word", "pos", "n", "term", "errors"])

    met = map_arrow(vocabulary, near, "word string, pos bigint, n bigint, term int, errors int").collect() if names else []  # words of the bounded sample
    once = np.zeros((len(names), 3, 2))
    for r in met:
        if r["n"] == 1:
            once[r["term"], r["errors"], r["pos"]] += 1
    rates = np.zeros((len(names), 3))
    weights = np.zeros((len(names), 3))
    weights[:, 0] = weight
    for t, r in enumerate(chosen):
        for d in (1, 2):
            clean = (once[t, d, 0] + 0.1) * (1 + p / max(n, 1))
            spelled = max(0.0, once[t, d, 1] - once[t, d, 0] * p / max(n, 1)) + MISSPELT[d] * r["pos"]
            rates[t, d] = spelled / (spelled + clean)
            weights[t, d] = min(weight[t], _odds(rates[t, d]) - _odds(base))
    own = {r["word"]: min(6.0, _odds((r["pos"] + WORTH * rates[r["term"], r["errors"]]) / (r["n"] + WORTH)) - _odds(base)) for r in met if r["n"] > 1}
    own |= {w: float(weights[t, 0]) for t, w in enumerate(names)}
    weights[weights < LEAST] = 0.0
    weights[[len(t) < TWO_ERRORS for t in names], 2] = 0.0
    model = Model(names, weights, {w: v if v >= LEAST else 0.0 for w, v in own.items()})
    shared = df.sparkSession.sparkContext.broadcast(model)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "text"):
            rows = [x for x, _ in shared.value.read(strings(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] + [batch.column(1)], [*"abcde", "toxic"])

    rows_ = map_arrow(texts, described, "a double, b double, c double, d double, e double, toxic int").groupBy(*"abcde").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    x = np.array([[r[c] for c in "abcde"] for r in rows_])
    model.beta = _fit(x, np.array([r["pos"] for r in rows_], float), np.array([r["n"] for r in rows_], float), _odds(base))
    return model


def _fit(x: np.ndarray, pos: np.ndarray, n: np.ndarray, bias: float) -> np.ndarray:
    """Logistic weights by Newton's method, under Gaussian priors: a quotation counts a tenth of abuse unless labels say more."""
    mean, precision = np.array([bias - 2, bias - 1, 0.6, 0.6, 0.06]), np.array([0.1, 0.1, 1.0, 1.0, 4.0])
    order = np.lexsort(x.T)
    x, pos, n = x[order], pos[order], n[order]
    beta = mean.copy()

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(np.sum(n * np.logaddexp(0, z) - pos * z) + 0.5 * np.sum(precision * (b - mean) ** 2))

    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        slope = x.T @ (pos - n * q) - precision * (beta - mean)
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + np.diag(precision), slope)
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return np.concatenate((beta[:2], np.maximum(beta[2:], 0)))


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with __score and __terms, the matching tokens in the order of their first places."""
    keep = df.columns if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slabs(batches, "__text"):
            found = list(model.read(strings(batch.column("__text"))))
            made = [pa.array([model.score(f) for f, _ in found], pa.float64()), pa.array([list(t) for _, t in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, "__score", "__terms"])

    rows = df.select(*[f"`{c}`" for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("__score", T.DoubleType()), T.StructField("__terms", T.ArrayType(T.StringType()))])
    return map_arrow(rows, run, schema)


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = score(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
