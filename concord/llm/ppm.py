"""Language identification by prediction by partial matching over UTF-8 bytes.

For each language a context tree of orders 0 to 3 is counted once and then frozen. The probability of a byte comes from
the longest context that the language's tree holds: if the byte was seen there, its count over (total + distinct), else
the escape probability distinct over (total + distinct) times what the next shorter context gives (escape method C); below
order 0 all 256 bytes are alike. The code length of a text is the sum of -log2 of these. Frozen values are kept by the
contexts and bytes that were seen, for some languages together, so that tables grow with the languages and not with their
square, and a text costs about one search a byte for each group of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_column, durable, small_batches, unused

PIECE = 1 << 17  # bytes scored at a time
ORDER = 3
TOGETHER = 8  # languages whose values stand in one line


def trainable(id_col: str = "doc_id") -> Column:
    """True for the four fifths of documents that may be learnt from (null ids count as the text of no number)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of byte n-grams (n = 1..4) by language, added up within the task: keys are n << 32 | bytes."""
    totals: dict[str, list] = {}

    def flush(lang: str) -> pa.RecordBatch:
        keys, counts = zip(*totals.pop(lang), strict=True)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(back, np.concatenate(counts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key), pa.array(n)], ["lang", "key", "n"])

    for batch in batches:
        raw, offs = binary_column(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            data = raw[offs[i] : offs[i + 1]].astype(np.int64)
            key = np.zeros(len(data), np.int64)
            for n in range(1, ORDER + 2):
                if len(data) < n:
                    break
                key = (key[: len(data) - n + 1] << 8) | data[n - 1 :]
                k, c = np.unique(key, return_counts=True)
                totals.setdefault(lang, []).append((k | (n << 32), c))
            if len(totals.get(lang, ())) > 400:
                yield flush(lang)
    for lang in list(totals):
        yield flush(lang)


@dataclass
class Block:
    """Some languages' frozen bits: cells are the sorted row << 8 | byte that any of them has seen, bits one line a cell;
    escape has the bits to leave a row, line local[row] (line 0: no language of the block has it)."""

    langs: int
    cells: np.ndarray
    bits: np.ndarray
    local: np.ndarray
    escape: np.ndarray


@dataclass
class Model:
    """Frozen statistics. A row is a context that some language has seen (row 0: the empty one); parent is the row of its
    suffix, -1 of the empty one. code maps a byte to one of A symbols (0: never seen), ids[(c0 * A + c1) * A + c2] is the row
    of the longest context that ends these three bytes. Everything but ids is as large as what was counted."""

    langs: list[str]
    code: np.ndarray
    ids: np.ndarray
    parent: np.ndarray
    blocks: list[Block]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1500) -> Model:
    """Learns one tree per language from whole texts of labelled documents.

    Bound, a parameter: about docs_per_lang documents of each language, chosen by a hash of the id (languages with fewer
    give all). All languages and all contexts of these documents count. No labelled row: an empty model.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sizes = durable(labelled.groupBy("lang").count())  # one row a language
    langs = [r["lang"] for r in sizes.orderBy("lang").collect()]
    share = F.pmod(F.xxhash64(F.col("id"), F.lit("ppm")), F.lit(1_000_000)) / 1e6
    wanted = labelled.join(F.broadcast(sizes), "lang").where(share < F.lit(float(docs_per_lang)) / F.col("count"))
    counted = wanted.select("lang", F.col("text").cast("binary").alias("data")).mapInArrow(_grams, "lang string, key long, n long")
    table = counted.groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    return _freeze(langs, table["lang"].to_numpy(), table["key"].to_numpy(np.int64), table["n"].to_numpy(np.int64))


def _freeze(langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray) -> Model:
    order, gram = key >> 32, key & 0xFFFFFFFF
    where = {x: i for i, x in enumerate(langs)}
    who = np.fromiter((where[x] for x in lang), np.int64, len(lang))
    seen = np.unique(gram[order == 1])
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    size = len(seen) + 1

    held, first = [np.zeros(1, np.int64)], [0]  # the contexts of each length, and the row of the first of them
    parent, ids = [np.array([-1])], np.zeros(1, np.int32)
    for k in range(1, ORDER + 1):
        held.append(np.unique(gram[order == k + 1] >> 8))
        first.append(first[-1] + len(held[-2]))
        parent.append(first[k - 1] + np.searchsorted(held[k - 1], held[k] & ((1 << 8 * (k - 1)) - 1)))
        place = np.zeros(len(held[k]), np.int64)
        for i in range(k - 1, -1, -1):
            place = place * size + code[(held[k] >> (8 * i)) & 255]
        ids = np.tile(ids, size)  # a context that no language has stands for its suffix
        ids[place] = np.arange(first[k], first[k] + len(held[k]))
    up, blocks = np.concatenate(parent), []
    for start in range(0, len(langs), TOGETHER):
        many = min(TOGETHER, len(langs) - start)
        mine = (who >= start) & (who < start + many)
        cells, bits, local, escape = [], [], np.zeros(len(up), np.int32), [np.zeros((1, many))]
        for k in range(ORDER + 1):
            pick = mine & (order == k + 1)
            w, count = who[pick] - start, n[pick]
            row = first[k] + np.searchsorted(held[k], gram[pick] >> 8)
            own, at = np.unique(row << 8 | gram[pick] & 255, return_inverse=True)
            rows, line = np.unique(row, return_inverse=True)
            total, kinds = np.zeros((len(rows), many)), np.zeros((len(rows), many))
            np.add.at(total, (line, w), count)
            np.add.at(kinds, (line, w), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            local[rows] = sum(map(len, escape)) + np.arange(len(rows))
            escape.append(leave)
            shorter = bits[-1][np.searchsorted(cells[-1], up[own >> 8] << 8 | own & 255)] if k else np.full((len(own), many), 8.0)
            found = shorter + leave[np.searchsorted(rows, own >> 8)]
            found[at, w] = -np.log2(count / (total[line, w] + kinds[line, w]))
            cells.append(own)
            bits.append(found)
        blocks.append(Block(many, np.concatenate(cells), np.concatenate(bits).astype(np.float32), local, np.concatenate(escape).astype(np.float32)))
    return Model(langs, code, ids, up, blocks)


def _bits(block: Block, parent: np.ndarray, row: np.ndarray, sym: np.ndarray) -> np.ndarray:
    """Bits of each byte under each language of the block: down the contexts until one has the byte."""
    out = np.zeros((len(row), block.langs), np.float32)
    live = np.arange(len(row))
    while len(live):
        key = row[live] << 8 | sym[live]
        at = np.minimum(np.searchsorted(block.cells, key), len(block.cells) - 1)
        hit = block.cells[at] == key if len(block.cells) else np.zeros(len(live), bool)
        out[live[hit]] += block.bits[at[hit]]
        live = live[~hit]
        out[live] += block.escape[block.local[row[live]]]
        row[live] = parent[row[live]]
        out[live[row[live] < 0]] += 8
        live = live[row[live] >= 0]
    return out


def code_lengths(model: Model, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bits of each text (rows) under each language (columns); raw and offs as in an Arrow binary column."""
    docs, many = len(offs) - 1, len(model.langs)
    out = np.zeros((docs, many))
    size = int(model.code.max(initial=0)) + 1
    code = model.code.astype(np.int32)
    for start in range(int(offs[0]), int(offs[-1]), PIECE):
        stop = min(start + PIECE, int(offs[-1]))
        back = min(ORDER, start - int(offs[0]))
        sym = code[raw[start - back : stop]]
        sym = np.concatenate([np.zeros(ORDER - back, np.int32), sym])
        first, last = int(np.searchsorted(offs, start, "right")) - 1, int(np.searchsorted(offs, stop, "left"))
        begins = offs[first:last]
        c = [sym[i : i + stop - start].copy() for i in range(ORDER)]  # c[0] is the byte three before
        for i in range(ORDER):  # no context reaches over the beginning of a text
            for late in range(ORDER - i):
                at = begins + late - start
                c[i][at[(at >= 0) & (at < stop - start)]] = 0
        row = model.ids[(c[0] * size + c[1]) * size + c[2]].astype(np.int64)
        edges = np.clip(begins - start, 0, None)
        filled = np.diff(np.concatenate([edges, [stop - start]])) > 0
        if not filled.any():
            continue
        done = 0
        for block in model.blocks:
            bits = _bits(block, model.parent, row.copy(), raw[start:stop].astype(np.int64))
            out[np.arange(first, last)[filled], done : done + block.langs] += np.add.reduceat(bits, edges[filled], axis=0, dtype=np.float64)
            done += block.langs
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", columns: list[str] | None = None) -> DataFrame:
    """The input rows with lang_out and score_out (0 to 1: the posterior of the best language with equal priors).

    columns: those of the input that the result has (all); a text that isn't among them doesn't come back from Python.

    Texts that are null or have no letter, and all texts under an empty model, give 'und' and 0. Ties go to the first
    language by name. Whole texts are scored, in pieces of bounded size.
    """
    keep = [c for c in (docs.columns if columns is None else columns) if c not in (lang_out, score_out)]
    text = keep.index(text_col) + 1 if text_col in keep else len(keep) + 1  # where its column is sent, once
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        names = np.array([*frozen.langs, "und"], object)
        for batch in batches:
            known = np.asarray(batch.column(0).fill_null(False).to_numpy(zero_copy_only=False), bool)
            best, score = np.full(batch.num_rows, len(frozen.langs)), np.zeros(batch.num_rows)
            if frozen.langs and known.any():
                bits = code_lengths(frozen, *binary_column(batch.column(text)))
                least = bits.min(axis=1)
                weight = 1 / np.exp2(-np.clip(bits - least[:, None], 0, 1000)).sum(axis=1)
                best = np.where(known, bits.argmin(axis=1), best)
                score = np.where(known, weight, 0)
            rest = batch.columns[1 : len(keep) + 1]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best], pa.string()), pa.array(score)], [*keep, lang_out, score_out])

    sent = [F.col(f"`{c}`") for c in keep] + [F.col(f"`{text_col}`")] * (text_col not in keep)
    data = docs.select(F.col(f"`{text_col}`").rlike(r"\p{L}").alias(unused(docs, "__letter")), *sent)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return data.mapInArrow(run, f"{schema}{', ' * bool(keep)}`{lang_out}` string, `{score_out}` double")

