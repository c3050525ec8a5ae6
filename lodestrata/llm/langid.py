"""Language identification by cross-parsing entropy.

Each language's sample becomes a suffix automaton. A text is cut greedily into the longest phrases that occur in the
sample; phrases times the sample's log length, by text length, estimates the cross entropy (Ziv and Merhav), and the
language with the least wins. The automata are complete transition tables: a missing transition leads to where the next
phrase begins and is marked by its sign, so that a batch of texts is parsed by numpy, one gather for each character and
language. Texts are parsed whole, in lanes of `LANE` characters side by side: each lane is parsed from the root first, then again
from the state in which the lane before it ends, up to the place where both parses are in one state, from where they agree;
this is repeated while a lane's last state changes, so that the phrases are those of the text read from end to end.

Only the samples are broadcast; each worker builds the automata from them once.

Letters are lower-cased, other characters are spaces. All letters of the samples are told apart, whatever the scripts: if
there are more than symbols, the frequent ones (by their shares in each language) have a symbol of their own and the others
are spelled in a fixed number of digits, so that the tables stay narrow. Only letters that are in no sample, which end a
phrase in every language, share a symbol. Sample: of documents that are not held out and have a language and
a letter, for each language the `SAMPLE_DOCS` distinct texts of least hash, whose first characters train it: `SAMPLE_CHARS` in
all, less if there are so many languages that all would exceed `TOTAL_CHARS`, evenly from all texts, where short texts leave
their rest to others. These bound the model whatever the corpus.

Defined cases: a null text and one without letters are `und` with score 0; ties go to the first language in order; the
score is the runner-up's share of both entropies (1 if there is one language); repeated rows are predicted each; a null
doc_id counts as not held out; other columns pass through; without labelled texts all are `und`; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, slabs, strings

SAMPLE_DOCS, SAMPLE_CHARS, TOTAL_CHARS = 64, 32_000, 400_000
LANE, CODES = 256, 64
_OTHER, _PAD = CODES - 2, CODES - 1
DIGITS = 32  # symbols that spell letters, if there are too many


def held_out(doc: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def _fold(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _shared(texts: list[str], chars: int) -> str:
    """Letters of all texts in lower case, with one space for each run of other characters, cut to even shares of `chars`."""
    plain = [re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).strip() for t in texts]
    left, share = chars, {}
    for k, i in enumerate(sorted(range(len(plain)), key=lambda i: len(plain[i]))):
        share[i] = min(len(plain[i]) + 1, left // (len(plain) - k))
        left -= share[i]
    return " ".join(plain[i][: max(0, share[i] - 1)] for i in range(len(plain)))


class Model:
    """Transition tables of all languages over one alphabet, built where they are first used."""

    def __init__(self, samples: dict[str, list[str]], chars: int = SAMPLE_CHARS, total: int = TOTAL_CHARS) -> None:
        self.names = sorted(samples)
        chars = min(chars, total // max(1, len(samples)))
        self.texts = [_shared(samples[k], chars) for k in self.names]

    def __getstate__(self) -> tuple:
        return self.names, self.texts

    def __setstate__(self, state: tuple) -> None:
        self.names, self.texts = state

    def __getattr__(self, name: str):
        if name not in ("codes", "symbols", "widths", "tables", "weights"):
            raise AttributeError(name)
        self._build()
        return self.__dict__[name]

    def _build(self) -> None:
        seen: Counter = Counter()
        for text in self.texts:
            own = Counter(c for c in text if c != " ")
            seen.update({c: n / own.total() for c, n in own.items()})
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        other = len(letters) + 1
        self.codes = np.zeros(0x110000, np.uint16 if other < 1 << 16 else np.uint32)  # 0: a space
        for block in range(0, 0x110000, 0x1000):
            self.codes[block : block + 0x1000] = [other if chr(i).isalpha() else 0 for i in range(block, block + 0x1000)]
        for i, c in enumerate(letters):
            self.codes[ord(c)] = i + 1
        single = len(letters) if len(letters) < _OTHER else _OTHER - 1 - DIGITS
        width = 1
        while DIGITS**width < len(letters) - single:
            width += 1
        rest = np.arange(len(letters) - single)
        #: The symbols of each letter, and how many they are.
        self.symbols = np.zeros((other + 1, width), np.uint8)
        self.symbols[: single + 1, 0], self.symbols[other, 0] = np.arange(single + 1), _OTHER
        for i in range(width):
            self.symbols[single + 1 : other, i] = _OTHER - DIGITS + rest // DIGITS ** (width - 1 - i) % DIGITS
        self.widths = np.ones(other + 1, np.int64)
        self.widths[single + 1 : other] = width
        self.tables, self.weights = [], []
        for text in self.texts:
            codes = self.encode(text)
            self.tables.append(_automaton(codes.tolist()))
            self.weights.append(math.log2(len(codes) + 2))

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text, with one space for each run of other characters."""
        codes = self.codes[_fold(text)]
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))] if len(codes) else codes
        if self.symbols.shape[1] == 1:
            return self.symbols[codes, 0]
        n = self.widths[codes]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.symbols[np.repeat(codes, n), at]

    def entropies(self, codes: list[np.ndarray]) -> np.ndarray:
        """Bits a character, for each text and language."""
        lengths = np.array([len(c) for c in codes], np.int64)
        lanes = -(-lengths // LANE)
        n = int(lanes.sum())
        flat = np.full(n * LANE, _PAD, np.uint8)
        at = np.repeat(np.cumsum(lanes * LANE) - lanes * LANE - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        if n:
            flat[at] = np.concatenate(codes)
        steps = np.ascontiguousarray(flat.reshape(n, LANE).T).astype(np.int32)
        of = np.repeat(np.arange(len(codes)), lanes)
        after = np.flatnonzero(of[1:] == of[:-1]) + 1  # lanes that go on from the one before
        out = np.zeros((len(codes), len(self.names)))
        for k, table in enumerate(self.tables):
            breaks = _breaks(table, steps, after)
            out[:, k] = (1 + np.bincount(of, breaks, len(codes))) * self.weights[k] / np.maximum(lengths, 1)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        codes = [self.encode(t) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        good = [i for i, c in enumerate(codes) if c.any()]
        if self.names and good:
            for i, row in zip(good, self.entropies([codes[i] for i in good]), strict=True):
                best = int(row.argmin())
                names[i] = self.names[best]
                rest = np.delete(row, best)
                scores[i] = float(rest.min() / (row[best] + rest.min())) if len(rest) else 1.0
        return names, scores


def _breaks(table: np.ndarray, steps: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Phrases that end in each lane (a column of steps), where the lanes `after` go on in the state in which the lane before ends."""
    n = steps.shape[1]
    seen, ended = np.empty(steps.shape, np.int32), np.empty(steps.shape, np.int16)
    state, count = np.zeros(n, np.int32), np.zeros(n, np.int16)
    for t, step in enumerate(steps):
        state = table[state + step]
        broke = state >> 31
        state ^= broke
        count -= broke.astype(np.int16)
        seen[t], ended[t] = state, count
    last, total = state.copy(), count.astype(np.int64)
    lane, again = after, False
    while len(lane):
        at, state, count = lane, last[lane - 1], np.zeros(len(lane), np.int64)
        was = last[lane]
        for t in range(len(steps)):
            state = table[state + steps[t, at]]
            broke = state >> 31
            state ^= broke
            count -= broke
            if not again:  # the first parse is known to the end from where both are in one state
                same = state == seen[t, at]
                if same.any():
                    met = at[same]
                    total[met] = count[same] + ended[-1, met] - ended[t, met]
                    at, state, count = at[~same], state[~same], count[~same]
                    if not len(at):
                        break
        total[at], last[at] = count, state
        moved = lane[last[lane] != was]
        lane, again = np.intersect1d(moved + 1, after, assume_unique=True), True
    return total


def _automaton(codes: list[int]) -> np.ndarray:
    """The suffix automaton's transitions, flat and premultiplied by CODES; a missing one is ~(where the root leads)."""
    most = max(2, 2 * len(codes))
    nexts = np.full((most, CODES), -1, np.int32)
    link, length = [-1] + [0] * (most - 1), [0] * most
    size, last = 1, 0
    for c in codes:
        new = size
        size += 1
        length[new] = length[last] + 1
        p = last
        while p >= 0 and nexts[p, c] < 0:
            nexts[p, c] = new
            p = link[p]
        if p >= 0:
            q = int(nexts[p, c])
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = size
                size += 1
                nexts[twin] = nexts[q]
                link[twin], length[twin] = link[q], length[p] + 1
                while p >= 0 and nexts[p, c] == q:
                    nexts[p, c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    nexts = nexts[:size]
    root = ~np.where(nexts[0] >= 0, nexts[0] * CODES, 0).astype(np.int32)
    table = np.where(nexts >= 0, nexts * CODES, root)
    table[:, _PAD] = np.arange(size, dtype=np.int32) * CODES
    return table.astype(np.int32).ravel()


def sample(df: DataFrame, text: str, lang: str, docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """For each language the `docs` distinct texts of least hash; df has the documents that may be learned from."""
    start = F.substring(F.regexp_replace(F.col(text).cast("string"), r"\P{L}+", " "), 1, SAMPLE_CHARS + 1)  # more is never used
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).cast("string").alias("__lang"), F.xxhash64(F.col(text).cast("string")).alias("__h"), start.alias("__text"))
    first = Window.partitionBy("__lang").orderBy("__h")
    few = rows.select("__lang", "__h").distinct().withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= docs).select("__lang", "__h").collect()
    if not few:
        return {}
    out: dict[str, dict[int, str]] = {}
    for r in rows.filter(F.col("__h").isin([x["__h"] for x in few])).groupBy("__lang", "__h").agg(F.first("__text").alias("__text")).collect():
        out.setdefault(r["__lang"], {})[r["__h"]] = r["__text"]
    return {k: [v[h] for h in sorted(v)] for k, v in out.items()}


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with __lang and __score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    keep = df.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slabs(batches, "__text", 2 << 20):
            names, scores = model.predict(strings(batch.column("__text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names), pa.array(scores)], [*keep, "__lang", "__score"])

    rows = df.select(*[f"`{c}`" for c in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType())])
    return map_arrow(rows, run, schema)


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", folds: int = 5, fold: int = 0) -> Model:
    return Model(sample(df.filter(~held_out(doc, folds, fold)), text, lang))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, train(docs), keep=["doc_id"]).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
