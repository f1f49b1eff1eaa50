"""Quality rules: plain counts, and the divergence of a text from the references of its language.

A reference is learnt from all documents of a language: its histogram over character classes, and its histogram over its
common words (those with a share of at least min_share of all its words) with one bin for the rest. A document fails the
method if the Jensen-Shannon distance (base 2, 0 to 1) of its own histogram to the reference is over a threshold, for
either histogram; texts shorter than the minimum lengths are too short to be told apart and pass.

Common words are found exactly in two passes with little to shuffle: each task keeps a bounded list of its frequent words,
whose counts are too low by a bounded share; no common word is missing among those whose sums come near min_share, and the
second pass counts just these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

SYMBOLS = b"#*$%&|<>"
CHUNK = 200_000  # words of a language that a task counts before it drops the less frequent ones
SLACK = 4  # lists of words are so many times as long as that of common words
PART = 1 << 20  # bytes of text handled at a time
CLASSES = ("lower", "upper", "digit", "blank", "stop", "symbol", "other_ascii", "non_ascii")


def _class_table() -> np.ndarray:
    """Class of each byte; continuation bytes have none, so that a character counts once."""
    table = np.full(256, 6, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[9, 10, 11, 12, 13, 32]] = 3
    table[[ord(c) for c in ".,;:!?'\"-()"]] = 4
    table[list(SYMBOLS)] = 5
    table[0xC0:] = 7
    table[0x80:0xC0] = len(CLASSES)
    return table


CLASS_OF = _class_table()


@dataclass
class Reference:
    """Frozen histograms: by language the classes' shares, the common words and their shares."""

    classes: dict[str, np.ndarray]
    words: dict[str, dict[bytes, int]]
    shares: dict[str, np.ndarray]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, bytes]]:
    for batch in batches:
        for lang, data in zip(batch.column(0), batch.column(1), strict=True):
            yield lang.as_py(), data.as_buffer().to_pybytes() if data.is_valid else b""


def _candidates(batches: Iterator[pa.RecordBatch], min_share: float) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): at most SLACK / min_share words a language and task, n at most that share / SLACK of its words too
    low; and its words' number, with a null word. Less frequent words are dropped with what they weigh off the others."""
    counts: dict[str, Counter] = {}
    pending: Counter = Counter()
    sizes: Counter = Counter()
    most = math.ceil(SLACK / min_share)

    def prune(lang: str) -> None:
        pending.pop(lang, None)
        if len(counts[lang]) > most:
            off = sorted(counts[lang].values(), reverse=True)[most]
            counts[lang] = Counter({w: n - off for w, n in counts[lang].items() if n > off})

    for lang, data in _texts(batches):
        words = data.lower().split()
        counts.setdefault(lang, Counter()).update(words)
        sizes[lang] += len(words)
        pending[lang] += len(words)
        if pending[lang] >= CHUNK:
            prune(lang)
    for lang in counts:
        prune(lang)
        found = [(None, sizes[lang]), *counts[lang].items()]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], ["lang", "word", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = 0.002) -> Reference:
    """References of all languages that a document is labelled with, however rare. Every whole text counts.

    A language has 1 / min_share common words at most, and the driver gets a third more as candidates; the languages are as
    many as there are labels. No labelled document: no reference.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    data = labelled.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").cast("binary").alias("data"))
    sums = durable(data.mapInArrow(lambda b: _candidates(b, min_share), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    sizes = sums.where("word is null").select("lang", F.col("n").alias("size"))
    langs = sorted(r["lang"] for r in sizes.collect())
    found = sums.where("word is not null").join(F.broadcast(sizes), "lang").where(F.col("n") >= F.col("size") * min_share * (1 - 1 / SLACK) - 1e-6).select("lang", "word").collect()
    wanted: dict[str, dict[bytes, int]] = {lang: {} for lang in langs}
    for r in sorted(found, key=lambda r: (r["lang"], bytes(r["word"]))):
        wanted[r["lang"]][bytes(r["word"])] = len(wanted[r["lang"]])
    shared = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = {lang: np.zeros(len(CLASSES) + 1, np.int64) for lang in shared.value}
        words = {lang: np.zeros(len(w) + 1, np.int64) for lang, w in shared.value.items()}
        for lang, data in _texts(batches):
            classes[lang] += np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)
            index, rest = shared.value[lang], len(shared.value[lang])
            words[lang] += np.bincount(np.array([index.get(w, rest) for w in data.lower().split()], np.int64), minlength=rest + 1)
        for lang in classes:
            rows = [(lang, 0, i, int(n)) for i, n in enumerate(classes[lang][:-1])] + [(lang, 1, i, int(n)) for i, n in enumerate(words[lang])]
            rows = [r for r in rows if r[3]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]], ["lang", "kind", "bin", "n"])

    sums = data.mapInArrow(count, "lang string, kind long, bin long, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n")).collect() if langs else []
    out = Reference({}, {}, {})
    for lang in langs:
        classes, words = np.zeros(len(CLASSES)), np.zeros(len(wanted[lang]) + 1)
        for r in sums:
            if r["lang"] == lang:
                (words if r["kind"] else classes)[r["bin"]] = r["n"]
        names = list(wanted[lang])
        common = [i for i in range(len(names)) if words[i] >= min_share * words.sum()]
        out.classes[lang] = classes / max(1.0, classes.sum())
        out.words[lang] = {names[i]: k for k, i in enumerate(common)}
        out.shares[lang] = np.append(words[common], words.sum() - words[common].sum()) / max(1.0, words.sum())
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histograms (along the last axis), base 2."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip(terms.sum(axis=-1) / 2, 0, 1))


def repeated_words(ids: np.ndarray, doc: np.ndarray, docs: int, window: int = 8) -> np.ndarray:
    """By document, the words in windows that occur twice or more in it. ids and doc: one entry a word, in order.

    Windows get exact numbers by doubling: pairs of neighbours, pairs of pairs and so on, numbered within documents.
    """
    hits = np.zeros(docs, np.int64)
    if len(ids) < window:
        return hits
    number, width = np.unique(ids, return_inverse=True)[1] + doc * (len(ids) + 1), 1
    while width < window:
        left, right = number[:-width], number[width:]
        number = np.unique(left * (int(number.max()) + 1) + right if int(number.max()) < 2**31 else _pairs(left, right), return_inverse=True)[1]
        width *= 2
    inside = doc[: len(number)] == doc[window - 1 :]
    many = np.bincount(number[inside], minlength=int(number.max()) + 1)[number] >= 2
    at = np.flatnonzero(many & inside)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.bincount(doc, np.cumsum(cover[:-1]) > 0, minlength=docs).astype(np.int64)


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers below 2**31 first, so that pairs fit 64 bits."""
    both = np.unique(np.concatenate([left, right]), return_inverse=True)[1]
    return both[: len(left)] * (int(both.max()) + 1) + both[len(left) :]


def measure(texts: list[bytes], langs: list[str | None], ref: Reference, min_chars: int, min_words: int) -> dict[str, np.ndarray]:
    """Counts and distances of a batch of texts."""
    docs = len(texts)
    index: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, docs)
    ids = np.fromiter((index.setdefault(w, len(index)) for words in split for w in words), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(docs), n_words)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(docs), np.fromiter(map(len, texts), np.int64, docs))
    classes = np.bincount(owner * (len(CLASSES) + 1) + CLASS_OF[raw], minlength=docs * (len(CLASSES) + 1)).reshape(docs, -1)[:, : len(CLASSES)]
    blank = classes[:, 3]
    out = {"n_words": n_words, "word_chars": classes.sum(axis=1) - blank, "n_symbols": classes[:, 5], "n_repeat_words": repeated_words(ids, doc, docs)}
    dup = np.zeros(docs, np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]
            dup[i] = len(lines) - len(set(lines))
    out["n_dup_lines"] = dup
    char_js, word_js = np.zeros(docs), np.zeros(docs)
    lower = np.array([w.lower() for w in index], object)
    shares = classes / np.maximum(1, classes.sum(axis=1))[:, None]
    told = np.array([x if x in ref.classes else None for x in langs], object)
    for lang in ref.classes:
        mine = np.flatnonzero((told == lang) | (told == None))  # noqa: E711
        if not len(mine):
            continue
        common, size = ref.words[lang], len(ref.shares[lang])
        bin_of = np.array([common.get(w, size - 1) for w in lower], np.int64) if len(lower) else np.zeros(0, np.int64)
        hist = np.bincount(doc * size + bin_of[ids], minlength=docs * size).reshape(docs, size)[mine]
        d_char = distance(shares[mine], ref.classes[lang])
        d_word = distance(hist / np.maximum(1, n_words[mine])[:, None], ref.shares[lang])
        first = told[mine] == lang
        # a text of unknown language has the distances of the nearest reference
        near = first | (char_js[mine] + word_js[mine] == 0) | (d_char + d_word < char_js[mine] + word_js[mine])
        char_js[mine[near]], word_js[mine[near]] = d_char[near], d_word[near]
    out["char_js"] = np.where(out["word_chars"] >= min_chars, char_js, 0.0)
    out["word_js"] = np.where(n_words >= min_words, word_js, 0.0)
    return out


def judge(docs: DataFrame, ref: Reference, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char_js: float = 0.28, max_word_js: float = 0.45, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """(id, counts, char_js, word_js, base_failed, kept), one row per input row.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed, and
    both distances within their thresholds. Distances are 0 for texts under the minimum lengths and without a reference;
    a text of unknown or null language is held against the nearest one. Null text: as empty. Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ref)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(batch.column(3).fill_null(0)))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")))
                part = batch.slice(at, upto - at)
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(2)]
                m = measure(texts, part.column(1).to_pylist(), shared.value, min_chars, min_words)
                failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
                kept = ~failed & (m["char_js"] <= max_char_js) & (m["word_js"] <= max_word_js)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(m[c]) for c in [*counts, "char_js", "word_js"]], pa.array(failed), pa.array(kept)], ["id", *counts, "char_js", "word_js", "base_failed", "kept"])
                at = upto

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    data = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), text.cast("binary").alias("data"), F.octet_length(text).cast("long").alias("size"))
    return data.mapInArrow(run, f"id {kind}, {', '.join(f'{c} long' for c in counts)}, char_js double, word_js double, base_failed boolean, kept boolean")
