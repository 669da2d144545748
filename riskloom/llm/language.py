"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

A word's score for a language is the sum of the log shares of its hashed character n-grams. Languages that do not
use the word's script are ruled out first. Over the words of a text, Viterbi with a penalty per switch finds the
best sequence of languages, so that a text in several languages falls into spans. The text's language is the one
that covers most of its letters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.arrow import slices, texts
from riskloom.llm.folds import hashed_below

#: The model is fitted on at most so many labelled rows a language (those by the hash of their id).
FIT_ROWS = 1_000
#: Buckets of hashed n-grams, and the longest n-gram.
BUCKETS, LONGEST = 1 << 16, 4
#: Cost of a change of language between two words, in units of log score.
SWITCH = 6.0
#: A language uses a script if that holds so much of its letters.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
CACHE_WORDS = 100_000
SLICE = 2 << 20

WORD = re.compile(r"[^\W\d_]+")

# First code points of Unicode blocks, each range running to the next start; "" is common to all.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, ""),
    (0x1780, "Khmer"), (0x1800, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"),
    (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""),
    (0xFB50, "Arabic"), (0xFE00, ""), (0x20000, "Han"), (0x32000, ""),
]
STARTS = [start for start, _ in SCRIPTS]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})


def script_of(word: str) -> int:
    """The number of the script of a word's first letter."""
    first = next((c for c in word if c.isalpha()), word[0])
    return SCRIPT_NAMES.index(SCRIPTS[bisect_right(STARTS, ord(first)) - 1][1])


@dataclass(frozen=True)
class LanguageModel:
    """``scores``: buckets x languages; ``allowed``: scripts x languages."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram of every word, and the number of its word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        if n > len(codes):
            break
        rolling = rolling[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        inside = owner[: len(owner) - n + 1] == owner[n - 1 :]
        if n == 1:
            inside = inside & (codes > 3)
        mixed = (rolling[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(48)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(inside)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on ``FIT_ROWS`` of the ``usable`` rows of each language at most; rows without language or text are left out."""
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    rows = known.select("id", "lang")
    # about a quarter more than wanted leave their tasks, then the smallest hashes of each language are taken
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(1.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.25 * FIT_ROWS / n, 1.0)).otherwise(share)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.where(hashed_below("id", share)).withColumn("place", F.row_number().over(by_hash))
    chosen = chosen.where(f"place <= {FIT_ROWS}").select("id").distinct()
    chosen = docs.sparkSession.createDataFrame(chosen.toArrow(), rows.select("id").schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(texts(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(w.lower() for w in WORD.findall(text))
            for lang, seen in words.items():
                if not seen:
                    continue
                buckets, owners = gram_buckets([*seen])
                weight = np.fromiter(seen.values(), np.float64, len(seen))
                total = np.bincount(buckets, weight[owners], BUCKETS)
                scripts = np.bincount([script_of(w) for w in seen], weight, len(SCRIPT_NAMES))
                cells = np.concatenate([total, scripts])
                held = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(held), pa.string()), pa.array(held, pa.int32()), pa.array(cells[held])],
                    names=["lang", "cell", "n"],
                )

    counted = (
        known.join(F.broadcast(chosen), "id", "left_semi")
        .select("text", "lang")
        .mapInArrow(count, "lang string, cell int, n double")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )  # at most languages x (buckets + scripts) rows
    languages = sorted({*counted.column("lang").to_pylist()})
    cells = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    where = {lang: i for i, lang in enumerate(languages)}
    columns = [where[x] for x in counted.column("lang").to_pylist()]
    cells[counted.column("cell").to_numpy(), columns] = counted.column("n").to_numpy()
    grams, scripts = cells[:BUCKETS] + 0.5, cells[BUCKETS:]
    scores = np.log(grams / grams.sum(0)).astype(np.float32) / LONGEST
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return LanguageModel(languages, scores, allowed)


class WordScores:
    """Scores of words, remembered by word; row 0 is for words without a letter."""

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1, len(self.model.languages)), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.rows) > CACHE_WORDS:
            self.clear()
        new = [w for w in words - self.rows.keys() if any(map(str.isalpha, w))]
        self.rows |= dict.fromkeys(words - self.rows.keys(), 0)
        if not new:
            return
        buckets, owners = gram_buckets([w.lower() for w in new])
        scores = np.empty((len(new), len(self.model.languages)), np.float32)
        for k in range(scores.shape[1]):
            scores[:, k] = np.bincount(owners, self.model.scores[buckets, k], len(new))
        scores[~self.model.allowed[[script_of(w) for w in new]]] -= 30
        self.rows |= {w: len(self.table) + i for i, w in enumerate(new)}
        self.table = np.concatenate([self.table, scores])


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word. ``scores`` holds the words of all texts one after another.

    All texts advance together, the longest first; among equal paths the lower label and staying win.
    """
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")
    came_from = np.zeros(scores.shape, np.int16)
    best = np.zeros((len(sizes), scores.shape[1]), np.float32)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t:
            source = best[:n].argmax(1)
            changed = best[np.arange(n), source] - switch
            stay = best[:n] >= changed[:, None]
            came_from[at] = np.where(stay, own, source[:, None])
            best[:n] = np.where(stay, best[:n], changed[:, None]) + scores[at]
        else:
            best[:n] = scores[at]
    state = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        state[:n] = came_from[at, state[:n]]
    return labels


def _spans(text: str, words: list[str], labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Runs of words with one label, as code point ranges."""
    if not words:
        return []
    turns = np.flatnonzero(np.diff(labels)) + 1
    if not len(turns):
        return [{"start": text.find(words[0]), "end": text.rfind(words[-1]) + len(words[-1]), "lang": languages[labels[0]]}]
    places = [m.span() for m in WORD.finditer(text)]
    firsts, lasts = [0, *turns], [*(turns - 1), len(words) - 1]
    return [
        {"start": places[a][0], "end": places[b][1], "lang": languages[labels[a]]}
        for a, b in zip(firsts, lasts, strict=True)
    ]


def label_texts(rows: list[str], scorer: WordScores) -> Iterator[tuple[str, float, list[dict]]]:
    """Per text its language, the confidence and the spans."""
    languages = scorer.model.languages
    words = [WORD.findall(t) for t in rows]
    scorer.learn(set().union(*words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    at = np.fromiter(map(scorer.rows.__getitem__, flat), np.int64, len(flat))
    scores = scorer.table[at]
    labels = viterbi(scores, lengths)
    letters = np.where(at > 0, np.fromiter(map(len, flat), np.int64, len(flat)), 0)
    ends = np.cumsum(lengths)
    for text, ws, end in zip(rows, words, ends, strict=True):
        part = slice(end - len(ws), end)
        weight = np.bincount(labels[part], letters[part], len(languages)) if ws else np.zeros(1)
        if not weight.sum():
            yield UNKNOWN, 0.0, []
            continue
        top = int(weight.argmax())
        own = scores[part][labels[part] == top].sum(0, dtype=np.float64)
        sure = 1 / np.exp(np.minimum(own - own[top], 0)).sum()
        yield languages[top], float(weight[top] / weight.sum() * sure), _spans(text, ws, labels[part], languages)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, lang_pred, score (0 to 1) and spans (start, end in code points; lang).

    The language covers most letters; of equals, the first in alphabetical order. The score is its share of the
    letters times the probability of the language given its own words. Null, empty and letterless texts are
    ``und`` with score 0 and no spans, and so is every text if no language was learned. Whole texts are read; rows
    that repeat stay; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScores(shared.value)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows = texts(part.column("text"))
                if shared.value.languages:
                    found = [*label_texts(rows, scorer)]
                else:
                    found = [(UNKNOWN, 0.0, [])] * len(rows)
                columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "lang_pred", "score", "spans"])

    kinds = (pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = (
        f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, "
        "spans array<struct<start:int,end:int,lang:string>>"
    )
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def identified(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language; ``und`` is rejected.

    If no language was learned, no text can be told by its language, and only texts without a letter are rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = WordScores(shared.value) if shared.value.languages else None
        for batch in batches:
            for part in slices(batch, text_col, SLICE):
                rows = texts(part.column(text_col))
                if scorer:
                    kept = [lang != UNKNOWN for lang, _, _ in label_texts(rows, scorer)]
                else:
                    kept = [WORD.search(text) is not None for text in rows]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
