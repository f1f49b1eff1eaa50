"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

The vocabulary is a .model file of the library's format, read here. A unigram file gives log probabilities; a BPE file
gives the rank of each piece instead, and its log scores are those of Zipf's law, -log(rank + 1). Text is marked: blanks
become U+2581, one is put in front. The best segmentation maximises the sum of scores; a character that no piece holds
costs the worst score less 10 and is written as the pieces of its UTF-8 bytes.

No piece continues over a marker that follows another character, so a text falls apart into units (markers and what
follows them) that are segmented on their own. A batch's distinct units are segmented together, position by position, by
array steps through the trie; long units the same way, in their own group.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unused

MARK = "▁"
PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
PART = 1 << 20  # characters of text handled at a time
LONG = 512  # bytes of a unit
CELLS = 1 << 19  # units times positions segmented at a time


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: (number, value)."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Vocabulary:
    """Pieces with log scores, and the double array: state t follows s by byte b if base[s] + b = t and check[t] = s;
    value[t] is the piece that ends in t, or -1."""

    pieces: list[bytes]
    score: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    byte_id: np.ndarray
    text_of: list[bytes]
    unknown: float
    splits_newline: bool

    def lists(self) -> tuple[list[int], list[int], list[int], list[float]]:
        """base, check, value and score as plain lists, for the walk of a single long unit."""
        if not hasattr(self, "_lists"):
            self._lists = (self.base.tolist(), self.check.tolist(), self.value.tolist(), self.score.tolist())
        return self._lists


def load(path: str) -> Vocabulary:
    """Reads a .model file (on the driver; the vocabulary is then broadcast, its size is the file's)."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, kinds, model = [], [], [], 1
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = b"", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append(piece)
            scores.append(score)
            kinds.append(kind)
        elif number == 2:
            model = dict(_fields(value)).get(3, 1)
    score = np.array(scores, np.float64)
    kind = np.array(kinds)
    if model == 2:  # ranks, not probabilities
        score = np.where(kind == NORMAL, -np.log1p(np.maximum(0.0, -score)), score)
    return vocabulary(pieces, score, kind)


def vocabulary(pieces: list[bytes], score: np.ndarray, kind: np.ndarray) -> Vocabulary:
    """Checks what the division into units needs, and builds the double array."""
    byte_id = np.full(256, -1, np.int64)
    usable = {}
    for i, piece in enumerate(pieces):
        if kind[i] == BYTE:
            byte_id[int(piece[3:5], 16)] = i
        elif kind[i] in (NORMAL, USER) and piece:
            usable[piece] = i
            if MARK in piece.decode("utf-8", "replace").lstrip(MARK):
                raise ValueError(f"piece {piece!r} goes on over a marker")
    normal = score[kind == NORMAL]
    base, check, value = _double_array(usable)
    text_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p for p, k in zip(pieces, kind, strict=True)]
    return Vocabulary(pieces, score, base, check, value, byte_id, text_of, float(normal.min(initial=0.0)) - PENALTY, not any(b"\n" in p for p in usable))


def _double_array(usable: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next-fit construction, node by node in breadth-first order."""
    children: dict[bytes, list[int]] = {b"": []}
    for piece in usable:
        for n in range(len(piece), 0, -1):
            known = piece[: n - 1] in children
            children.setdefault(piece[:n], [])
            children.setdefault(piece[: n - 1], []).append(piece[n - 1])
            if known:
                break
    size = 1 << max(10, (len(children) * 2 + 512).bit_length())
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    hints, queue = [1] * 257, [(b"", 0)]  # where the last node of so many branches went: what lies before is dense
    for prefix, state in queue:
        value[state] = usable.get(prefix, -1)
        labels = np.array(sorted(set(children[prefix])), np.int64)
        if not len(labels):
            continue
        at = hints[len(labels)]
        while True:  # try a stretch of bases at once
            tries = np.arange(at, at + 256)
            if tries[-1] + 256 >= len(free):
                grow = len(free)
                base, check, value = (np.concatenate([x, np.full(grow, fill, np.int32)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                free = np.concatenate([free, np.ones(grow, bool)])
            fits = free[tries[:, None] + labels].all(axis=1)
            if fits.any():
                at = int(tries[fits.argmax()])
                break
            at += 256
        hints[len(labels)] = at
        base[state] = at
        check[at + labels] = state
        free[at + labels] = False
        queue.extend((prefix + bytes([b]), at + b) for b in labels.tolist())
    used = int(np.flatnonzero(~free).max()) + 257
    return base[:used], check[:used], value[:used]


def segment(vocab: Vocabulary, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, scores): piece ids of all units one after another, where each unit's end, and its score.

    Units of about equal length share a matrix of bytes; best[i, p] is the best score of the first p bytes of unit i. Units
    longer than LONG bytes are walked one by one.
    """
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(sizes, kind="stable")
    counts, scores = np.zeros(len(units), np.int64), np.zeros(len(units))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(order):
        if sizes[order[at]] > LONG:
            group = order[at : at + 1]
            ids, scores[group] = _segment_one(vocab, units[group[0]])
            counts[group] = len(ids)
        else:
            longest = int(sizes[order[at]]) * 5 // 4 + 4
            upto = min(int(np.searchsorted(sizes[order], min(longest, LONG), "right")), at + max(1, CELLS // longest))
            group = order[at:upto]
            ids, counts[group], scores[group] = _segment(vocab, [units[i] for i in group])
        done.append((group, ids))
        at += len(group)
    ends = np.cumsum(counts)
    out = np.zeros(int(counts.sum()), np.int64)
    for group, ids in done:
        n = counts[group]
        out[np.repeat(ends[group] - np.cumsum(n), n) + np.arange(len(ids))] = ids
    return out, ends, scores


def _segment_one(vocab: Vocabulary, unit: bytes) -> tuple[np.ndarray, float]:
    """The same for one unit of any length, byte by byte."""
    base, check, value, score = vocab.lists()
    size, limit = len(unit), len(base)
    best, back, last = [-np.inf] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
    best[0] = 0.0
    for p in range(size):
        here, lead = best[p], unit[p]
        if here == -np.inf or lead & 0xC0 == 0x80:
            continue
        step = min(1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), size - p)
        covered, state, q = False, 0, p
        while q < size and base[state]:
            follow = base[state] + unit[q]
            if follow >= limit or check[follow] != state:
                break
            state, q = follow, q + 1
            piece = value[state]
            if piece >= 0:
                covered = covered or q - p == step
                total = here + score[piece]
                if total > best[q]:
                    best[q], back[q], last[q] = total, p, piece
        if not covered and here + vocab.unknown > best[p + step]:
            best[p + step], back[p + step], last[p + step] = here + vocab.unknown, p, -1
    out, end = [], size
    while end:
        begin = back[end]
        out += [last[end]] if last[end] >= 0 else vocab.byte_id[list(unit[begin:end])][::-1].tolist()
        end = begin
    return np.array(out[::-1], np.int64), best[size]


def _segment(vocab: Vocabulary, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all units, their counts, scores) of units of about equal length."""
    rows, sizes = len(units), np.fromiter(map(len, units), np.int64, len(units))
    width = int(sizes.max(initial=0))
    if not width:
        return np.zeros(0, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
    flat = np.zeros((rows, width), np.uint8)
    flat[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(units), np.uint8)
    lead = (flat & 0xC0) != 0x80
    span = 1 + (flat >= 0xC0).astype(np.int64) + (flat >= 0xE0) + (flat >= 0xF0)
    best = np.full((rows, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((rows, width + 1), np.int32)  # where the last piece begins
    last = np.full((rows, width + 1), -1, np.int32)  # the last piece, -1 for an unknown character
    limit = len(vocab.base)
    for p in range(width):
        live = np.flatnonzero((p < sizes) & lead[:, p] & (best[:, p] > -np.inf))
        if not len(live):
            continue
        here = best[live, p]
        step = np.minimum(span[live, p], sizes[live] - p)
        covered = np.zeros(len(live), bool)
        who, state, q = np.arange(len(live)), np.zeros(len(live), np.int64), p
        while len(who) and q < width:
            inside = q < sizes[live[who]]
            who, state = who[inside], state[inside]
            if not len(who):
                break
            follow = vocab.base[state].astype(np.int64) + flat[live[who], q]
            ok = (vocab.base[state] > 0) & (follow < limit)
            ok[ok] = vocab.check[follow[ok]] == state[ok]
            who, state = who[ok], follow[ok]
            q += 1
            piece = vocab.value[state]
            ends = piece >= 0
            if ends.any():
                w, ids = who[ends], piece[ends].astype(np.int64)
                covered[w[step[w] == q - p]] = True
                total = here[w] + vocab.score[ids]
                r = live[w]
                better = total > best[r, q]
                r = r[better]
                best[r, q], back[r, q], last[r, q] = total[better], p, ids[better]
        lone = np.flatnonzero(~covered)
        r, q = live[lone], p + step[lone]
        total = here[lone] + vocab.unknown
        better = total > best[r, q]
        r, q = r[better], q[better]
        best[r, q], back[r, q], last[r, q] = total[better], p, -1
    # walk back from the end of all units at once
    chosen: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    who, end = np.flatnonzero(sizes > 0), sizes[sizes > 0]
    while len(who):
        begin = back[who, end]
        chosen.append((who, begin, end, last[who, end]))
        who, end = who[begin > 0], begin[begin > 0]
    who, begin, end, piece = (np.concatenate(x) for x in zip(*chosen, strict=True))
    known = np.flatnonzero(piece >= 0)
    lone = np.flatnonzero(piece < 0)
    many = end[lone] - begin[lone]
    place = np.repeat(begin[lone] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(lone) else np.zeros(0, np.int64)
    owner = np.repeat(who[lone], many)
    who = np.concatenate([who[known], owner])
    begin = np.concatenate([begin[known], place])
    piece = np.concatenate([piece[known], vocab.byte_id[flat[owner, place]]])
    order = np.argsort(who * (width + 1) + begin)
    return piece[order], np.bincount(who, minlength=rows), best[np.arange(rows), sizes]


def units_of(text: str, splits_newline: bool) -> list[str]:
    """The units of a marked text."""
    if "  " in text or MARK in text or text[:1] == " ":
        found = UNIT.findall(MARK + text.replace(" ", MARK))
    else:
        found = [MARK + w for w in text.split(" ")]
    if not splits_newline or "\n" not in text:
        return found
    out = []
    for unit in found:
        if "\n" in unit:
            out += [x for x in re.split("(\n)", unit) if x]
        else:
            out.append(unit)
    return out


def encode_batch(vocab: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, scores) of a batch of texts; null and empty texts have no ids."""
    index: dict[bytes | str, int] = {}
    marks = [[index.setdefault(u, len(index)) for u in units_of(t, vocab.splits_newline)] if t else [] for t in texts]
    ids, ends, scores = segment(vocab, [u.encode() for u in index])
    counts = np.fromiter(map(len, marks), np.int64, len(marks))
    unit = np.fromiter((i for m in marks for i in m), np.int64, int(counts.sum()))
    sizes = np.diff(np.concatenate([[0], ends]))
    n = sizes[unit]
    start = (ends - sizes)[unit]
    out = ids[np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(unit) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    lengths = np.bincount(row, n, minlength=len(texts)).astype(np.int64)
    total = np.bincount(row, scores[unit], minlength=len(texts)).astype(np.float64)
    return out, np.cumsum(lengths), total


def encode(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", ids_out: str = "ids", score_out: str = "log_score") -> DataFrame:
    """The input rows with ids_out (array of int, null for a null text, empty for an empty one) and score_out.

    Columns of these names are replaced. Whole texts are encoded, a bounded number of characters (or one text) at a time.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (ids_out, score_out)]
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.asarray(batch.column(0).fill_null(0)))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PART, "right")))
                part = batch.slice(at, upto - at)
                texts = part.column(1).to_pylist()
                ids, ends, scores = encode_batch(shared.value, texts)
                null = np.array([t is None for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*part.columns[2:], lists, pa.array(scores, mask=null)], [*keep, ids_out, score_out])
                at = upto

    text = F.col(f"`{text_col}`")
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    data = docs.select(F.length(text).cast("long").alias(unused(docs, "__size")), text.alias(unused(docs, "__text")), *[F.col(f"`{c}`") for c in keep])
    return data.mapInArrow(run, f"{schema}`{ids_out}` array<int>, `{score_out}` double")


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """Bytes of the pieces, markers back to blanks, less the blank that encoding put in front."""
    text = b"".join(map(vocab.text_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text[:1] == " " else text


def decode(rows: DataFrame, vocab: Vocabulary, ids_col: str = "ids", text_out: str = "decoded") -> DataFrame:
    """The input rows, ids_col replaced by text_out. Null ids: null. Control pieces have no text; bytes that aren't UTF-8
    give U+FFFD. Every text comes back as it was, but that a U+2581 in it comes back as a blank."""
    small_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c not in (ids_col, text_out)]
    shared = rows.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, vocab = batch.column(0), shared.value
            for at in range(0, batch.num_rows, 256):
                part = column.slice(at, 256)
                texts = [None if not x.is_valid else decode_ids(vocab, x.values.to_numpy().tolist()) for x in part]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, 256) for c in batch.columns[1:]], pa.array(texts, pa.string())], [*keep, text_out])

    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(F.col(f"`{ids_col}`"), *[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{schema}`{text_out}` string")

