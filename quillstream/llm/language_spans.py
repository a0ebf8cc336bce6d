"""Language of texts, with spans of mixed-language texts.

Words are runs of letters, with the marks behind them.  The script of a word narrows the languages to those that the training words
of that script showed; the rest get a score from hashed character n-grams (with word ends), learned from
labelled documents.  A Viterbi pass over the word scores, with a penalty for each switch, labels every
word; runs of equal labels are the spans.  The language of a text is that with the most letters in its
spans, and the score is its share of the letters.

Training counts n-grams in a bounded sample of labelled documents (`sample_docs`) and gathers one row
for each language and n-gram bucket, so what comes to the driver does not grow with the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_in_arrow, slices

#: n-gram buckets, as a power of two, and the longest n-gram.
BITS, LONGEST = 16, 4
#: Documents that the classifier learns from, about.
SAMPLE_DOCS = 20_000
#: Floor of an n-gram's probability; equal for all languages, so unseen n-grams decide nothing.
FLOOR = 2e-6
#: Cost of a switch of language between two words, in the units of the word scores.
SWITCH = 12.0
#: A language is a candidate for a script that holds this share of its training words.
SCRIPT_SHARE = 0.002
#: Words whose scores or counts a task keeps, and their scores in all; then it starts anew.
KEPT_WORDS, KEPT_SCORES = 300_000, 4_000_000
#: Bytes of a model, which goes to every task; it has 2^BITS weights for each language.
MOST_MODEL = 1 << 30
UNDETERMINED = "und"

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
# First code points of script ranges (Unicode blocks, coarsely), each up to the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFE0, "other"), (0x20000, "han"), (0x40000, "other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


class Model(NamedTuple):
    """languages; log-probability of each bucket (buckets x languages); candidates (scripts x languages)."""

    languages: tuple[str, ...]
    weights: np.ndarray
    candidates: np.ndarray


def lowered(text: str) -> str:
    """The text in lower case, character by character where whole texts would change their length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return _WORD.findall(lowered(text))


def ngrams(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, the word that each belongs to, and each word's script."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    script = _SCRIPT_OF[np.searchsorted(_SCRIPT_STARTS, codes[starts + 1], side="right") - 1]
    buckets, owners = [], []
    rolled = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolled = rolled[:size] * np.uint64(0x100000001B3) + codes[n - 1 :]
        whole = owner[:size] == owner[n - 1 :]
        mixed = (rolled[whole] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
        owners.append(owner[:size][whole])
    return np.concatenate(buckets), np.concatenate(owners), script


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled documents; rows with null text or label are left out.

    Of more than `sample_docs` documents a sample by hash of the id is taken.  Nothing to learn from
    gives a model without languages.  Raises ValueError for so many languages that the model would be
    larger than MOST_MODEL bytes (4,096 languages).
    """
    labelled = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    total = labelled.select(id_col).count()
    if total > sample_docs:
        scale = 1 << 20
        labelled = labelled.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(scale)) < int(scale * sample_docs / total) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        tables: dict[str, np.ndarray] = {}

        def fold(lang: str) -> None:
            held = seen.pop(lang)
            words = list(held)
            for start in range(0, len(words), 20_000):  # n-grams take far more room than their words
                part = words[start : start + 20_000]
                times = np.fromiter(map(held.__getitem__, part), dtype=np.float64, count=len(part))
                bucket, owner, script = ngrams(part)
                table = tables.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPT_NAMES)))
                table[: 1 << BITS] += np.bincount(bucket, times[owner], 1 << BITS)
                table[1 << BITS :] += np.bincount(script, times, len(SCRIPT_NAMES))

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                held = seen.setdefault(lang.as_py(), Counter())
                held.update(words_of(text.as_py()))
                if len(held) > KEPT_WORDS:
                    fold(lang.as_py())
        for lang in list(seen):
            fold(lang)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(table[at], pa.float64())], names=["lang", "bucket", "n"])

    names = labelled.select(F.col(lang_col).cast("string").alias("lang")).distinct()
    most = MOST_MODEL // (4 << BITS)
    if names.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages")
    counted = labelled.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(count, "lang string, bucket int, n double")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts = np.zeros(((1 << BITS) + len(SCRIPT_NAMES), max(1, len(languages))))
    counts[table["bucket"].to_numpy(int), table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = table["n"]
    grams, scripts = counts[: 1 << BITS], counts[1 << BITS :]
    weights = np.log(grams / np.maximum(grams.sum(axis=0), 1) + FLOOR)
    candidates = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
    return Model(languages, weights.astype(np.float32), candidates)


class WordScores:
    """Scores of words for each language, kept between batches."""

    def __init__(self, model: Model):
        self.model = model
        self.start()

    def start(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 10, len(self.model.languages)), dtype=np.float32)

    def of(self, texts: Sequence[list[str]]) -> list[np.ndarray]:
        """Rows of `table` for the words of each text."""
        if len(self.place) > min(KEPT_WORDS, KEPT_SCORES // max(1, len(self.model.languages))):
            self.start()
        place = self.place
        new = list(dict.fromkeys(w for words in texts for w in words if w not in place))
        step = max(500, min(20_000, KEPT_SCORES // (100 * max(1, len(self.model.languages)))))
        for start in range(0, len(new), step):
            self._add(new[start : start + step])
        return [np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]

    def _add(self, words: list[str]) -> None:
        bucket, owner, script = ngrams(words)
        order = np.argsort(owner, kind="stable")
        first = np.concatenate([[0], np.flatnonzero(np.diff(owner[order])) + 1])
        # An n-gram of every length covers each letter, so their sum counts a letter LONGEST times.
        scores = np.add.reduceat(self.model.weights[bucket[order]], first, axis=0) / LONGEST
        scores -= scores.max(axis=1, keepdims=True)
        allowed = self.model.candidates[script]
        some = allowed.any(axis=1)
        scores[some] = np.where(allowed[some], scores[some], -50.0)
        scores[~some] = 0.0
        at = len(self.place)
        while at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(words)] = scores
        self.place.update(zip(words, range(at, at + len(words))))


def viterbi(rows: Sequence[np.ndarray], table: np.ndarray, switch: float = SWITCH, most_cells: int = 1 << 21) -> list[np.ndarray]:
    """Best language of every word of each text; texts of like length go side by side.

    Of equally good paths, one that stays goes before one that switches, and then the first language.
    """
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    at, k = 0, table.shape[1]
    kind = np.int8 if k < 128 else np.int32
    out: list[np.ndarray] = [np.zeros(0, dtype=kind)] * len(rows)
    while at < len(order) and lengths[order[at]]:
        steps = int(lengths[order[at]])
        group = order[at : at + max(1, most_cells // (steps * k))]
        group = group[lengths[group] > 0]
        at += len(group)
        longer = np.searchsorted(-lengths[group], -np.arange(steps), side="left")  # texts that have word t
        ids = np.zeros((steps, len(group)), dtype=np.int64)
        for j, i in enumerate(group):
            ids[: lengths[i], j] = rows[i]
        back = np.empty((steps, len(group), k), dtype=kind)
        value = np.zeros((len(group), k), dtype=np.float64)
        own = np.arange(k, dtype=kind)
        for t in range(steps):
            n = longer[t]
            v = value[:n]
            best = v.max(axis=1, keepdims=True)
            stay = v >= best - switch
            back[t, :n] = np.where(stay, own, v.argmax(axis=1)[:, None])
            value[:n] = np.where(stay, v, best - switch) - best + table[ids[t, :n]]
        state = value.argmax(axis=1)
        labels = np.zeros((steps, len(group)), dtype=kind)
        for t in range(steps - 1, -1, -1):
            n = longer[t]
            labels[t, :n] = state[:n]
            state[:n] = back[t, np.arange(n), state[:n]]
        for j, i in enumerate(group):
            out[i] = labels[: lengths[i], j].copy()
    return out


def spans_of(text: str, labels: np.ndarray, languages: Sequence[str]) -> list[tuple[int, int, str]]:
    """(start, end, language) of the runs of equal labels, in code points of the text."""
    spans: list[list] = []
    for word, label in zip(_WORD.finditer(lowered(text)), labels):
        if spans and spans[-1][2] == label:
            spans[-1][1] = word.end()
        else:
            spans.append([word.start(), word.end(), label])
    return [(s, e, languages[x]) for s, e, x in spans]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True, switch: float = SWITCH, keep: Sequence[str] = ()) -> DataFrame:
    """Language of every text.

    Returns id, lang_pred, score and (if `with_spans`) spans, an array of start, end, lang: one row per
    input row, repeated rows and null ids included.  A text that is null, empty or without letters, and
    any text under a model without languages, is `und` with score 0 and no spans.  Of languages with
    equal letters the first by name holds.  Texts are read whole.  Other columns are left out; with
    `keep`, the text and a struct named kept, with the columns in `keep`, come along.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets for each language
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(shared.value)
        languages = shared.value.languages
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                words = [words_of(t) if languages else [] for t in texts]
                rows = scores.of(words)
                labels = viterbi(rows, scores.table, switch)
                predicted, share, spans = [], [], []
                for text, own, label in zip(texts, words, labels):
                    if not own:
                        predicted.append(UNDETERMINED)
                        share.append(0.0)
                        spans.append([])
                        continue
                    letters = np.bincount(label, np.fromiter(map(len, own), dtype=np.int64, count=len(own)), len(languages))
                    best = int(letters.argmax())
                    predicted.append(languages[best])
                    share.append(float(letters[best] / letters.sum()))
                    if with_spans:
                        spans.append([{"start": s, "end": e, "lang": x} for s, e, x in spans_of(text, label, languages)])
                columns = [part.column("id"), pa.array(predicted, pa.string()), pa.array(share, pa.float64())]
                columns += [pa.array(spans, span_type)] if with_spans else []
                columns += [part.column("text"), part.column("kept")] if keep else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    schema = f"`{id_col}` {kind}, lang_pred string, score double" + (", spans array<struct<start:bigint,end:bigint,lang:string>>" if with_spans else "")
    schema += f", `{text_col}` string, kept {chosen.schema['kept'].dataType.simpleString()}" if keep else ""
    names = [id_col, "lang_pred", "score", *(["spans"] if with_spans else []), *([text_col, "kept"] if keep else [])]
    return map_in_arrow(chosen, run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
