"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments (21, 21, 22 bits). Two fingerprints that differ in at most four bits
have a segment that differs in at most one, and so share the variant of that segment in which this bit is a wildcard.
Each distinct fingerprint is indexed under its 64 one-wildcard variants; rows of equal variants meet by a shuffle on the
variant, are verified by popcount, and only a spanning forest of every bucket's links is kept. Nothing in a bucket is
capped: small buckets compare all pairs with array shifts, large ones are explored breadth-first against what is still
unvisited, which needs eight bytes a fingerprint and few comparisons when the bucket is one dense group of copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import durable, shuffles_dropped, sized, small_batches, unused
from .components import components

SEGMENTS = ((0, 21), (21, 21), (42, 22))
BLOCK = 1 << 14  # shingles hashed at a time
LANE = 28  # bits of a key below its lane
HALVES = tuple(h for o, w in SEGMENTS for h in ((o, w // 2), (o + w // 2, w - w // 2)))  # of segments, low and high by turns
VALUE, TURN = 11, 14  # bits of a half's key below its number, and below the band's turn
AT_ONCE = 1 << 22  # rows of halves that are dealt at a time
DENSE = 6  # links of a small bucket from which they are thinned
FIRST = 4  # bands whose links are verified before the others meet
SMALL = 64  # buckets up to this size compare all pairs by shifts
MASKS = np.array([((1 << width) - 1) << offset for offset, width in HALVES], np.uint64)


def _hashes(data: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of UTF-8 text, repeats included, a block at a time."""
    words = data.lower().split()  # for bytes: A-Z only; space and \x09-\x0D only
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for at in range(0, len(starts), BLOCK):
        pairs = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        yield np.fromiter((xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in pairs), np.uint64)


def folded(blocks: Iterable[np.ndarray]) -> int:
    """Unsigned fingerprint of hashes that come in blocks: a bit is set if it is set in over half of them."""
    total, count = np.zeros(64, np.int64), 0
    for hashes in blocks:
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        count += len(hashes)
    return sum(1 << int(i) for i in np.flatnonzero(2 * total > count))


def fingerprint(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of UTF-8 text: a bit is set if it is set in over half of the shingles' XXH64."""
    return folded(_hashes(data, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) with fp as a signed long, one row per input row. Null or blank text: 0. Extra columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    return narrow.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _lane(key: np.ndarray) -> np.ndarray:
    return key >> LANE


def _near(bits: np.ndarray, most: int) -> np.ndarray:
    """Which words (or rows of words, added up) have at most so many bits."""
    count = np.bitwise_count(bits)
    return (count if count.ndim == 1 else count.sum(axis=1)) <= most


def _small_links(key: np.ndarray, own: np.ndarray, sig: np.ndarray, lane_bits: int, max_bits: int, apart: np.ndarray | None = None) -> list[np.ndarray]:
    """Index pairs of the links of all pairs of equal key, by shifting the sorted rows against themselves.

    apart: bits in which some one has to differ for a pair to count, none for any.
    """
    found, at, shift = [], np.arange(len(key)), 1
    while len(at := at[at + shift < len(key)]) and len(at := at[key[at] == key[at + shift]]):
        bits = own[at] ^ own[at + shift]
        near = _near(bits, lane_bits)
        hit = at[near if apart is None else near & ((bits & apart[at] != 0) | (apart[at] == 0))]
        hit = hit[_near(sig[hit] ^ sig[hit + shift], max_bits)]
        if len(hit):
            found.append(np.stack([hit, hit + shift]))
        shift += 1
    return found


def _thinned(found: list[np.ndarray], key: np.ndarray, sig: np.ndarray, lane_bits: int, max_bits: int) -> list[np.ndarray]:
    """The same links, but a spanning forest in each bucket that has DENSE links or more."""
    if not found:
        return found
    every = np.concatenate(found, axis=1)
    every = every[:, np.argsort(every[0], kind="stable")]
    keys, first, count = np.unique(key[every[0]], return_index=True, return_counts=True)
    dense = count >= DENSE
    out = [every[:, np.repeat(~dense, count)]]
    for k, s, n in zip(keys[dense].tolist(), first[dense].tolist(), count[dense].tolist(), strict=True):
        rows = np.unique(every[:, s : s + n])
        out += [rows[e] for e in forest(sig[rows], _lane(k), lane_bits, max_bits)]
    return out


def forest(sig: np.ndarray, lane: int, lane_bits: int, max_bits: int, apart: np.uint64 = np.uint64(0)) -> list[np.ndarray]:
    """Index pairs of a spanning forest of the links among signatures: each one reached is compared with the unvisited only."""
    own, found, rest = sig[:, lane], [], np.arange(len(sig))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            bits = own[rest] ^ own[x]
            hit = np.flatnonzero(_near(bits, lane_bits) & (bits & apart != 0) if apart else _near(bits, lane_bits))
            hit = hit[_near(sig[rest[hit]] ^ sig[x], max_bits)]
            if len(hit):
                new = rest[hit]
                found.append(np.stack([np.full(len(new), x), new]))
                queue.extend(new)
                rest = np.delete(rest, hit)
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and the other columns, as unsigned, of rows that come sorted by key: blocks of whole keys."""
    held_key: list[np.ndarray] = []
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held_key.append(batch.column(0).to_numpy())
        held.append(np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).view(np.uint64))
        if held_key[0][0] != held_key[-1][-1] and sum(map(len, held_key)) >= BLOCK:
            key, rows = np.concatenate(held_key), np.concatenate(held)
            cut = int(np.searchsorted(key, key[-1]))
            held_key, held = [key[cut:]], [rows[cut:]]
            yield key[:cut], rows[:cut]
    if held_key:
        yield np.concatenate(held_key), np.concatenate(held)


def _sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each key."""
    first = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return first, np.diff(np.concatenate([first, [len(key)]]))


def _links(batches: Iterator[pa.RecordBatch], lane_bits: int, max_bits: int, out: list[str]) -> Iterator[pa.RecordBatch]:
    """Links within buckets of rows (key, signature)."""
    for key, sig in _blocks(batches):
        first, size = _sizes(key)
        big = size > SMALL
        at = np.flatnonzero(np.repeat(~big, size))
        small, lanes = key[at], sig[at]
        links = _small_links(small, lanes[np.arange(len(at)), _lane(small)], lanes, lane_bits, max_bits)
        found = [at[e] for e in _thinned(links, small, lanes, lane_bits, max_bits)]
        for s, n in zip(first[big].tolist(), size[big].tolist(), strict=True):
            found += [e + s for e in forest(sig[s : s + n], _lane(int(key[s])), lane_bits, max_bits)]
        if found:
            a, b = np.concatenate(found, axis=1)
            columns = np.concatenate([sig[a], sig[b]], axis=1).view(np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], out)


def _spanned(sig: np.ndarray, part: np.ndarray, mask: np.uint64, low: bool, lane_bits: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links among rows that share a half, and each row's tree.

    mask: the bits of the segment's other half. Rows of one part are connected already; in a tree they hang on the first of
    theirs that it reached. low: the other half is the low one, so equal segments count here.
    """
    own, tree, found, rest, trees = sig[:, 0], np.zeros(len(sig), np.int64), [], np.arange(len(sig)), 0

    def take(reached: np.ndarray) -> list[int]:
        """Takes out of the rest all rows of the parts of those reached, one of each part."""
        nonlocal rest
        order = np.argsort(part[reached])
        reached = reached[order]
        place = np.minimum(np.searchsorted(part[reached], part[rest]), len(reached) - 1)
        same = part[reached[place]] == part[rest]
        new, by = rest[same], reached[place[same]]
        rest, tree[new] = rest[~same], trees
        if (hung := new != by).any():
            found.append(np.stack([by[hung], new[hung]]))
        return new.tolist()

    while len(rest):
        queue = take(rest[:1])
        while queue and len(rest):
            x = queue.pop()
            bits = own[rest] ^ own[x]
            inner = np.bitwise_count(bits & mask)
            hit = np.flatnonzero((inner <= 1) & (low | (inner > 0)) & _near(bits, lane_bits))
            hit = hit[_near(sig[rest[hit]] ^ sig[x], max_bits)]
            if len(hit):
                reached = rest[hit]
                reached = reached[np.unique(part[reached], return_index=True)[1]]
                found.append(np.stack([np.full(len(reached), x), reached]))
                queue.extend(take(reached))
        trees += 1
    return np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), tree


def _half_links(batches: Iterator[pa.RecordBatch], lane_bits: int, max_bits: int) -> Iterator[pa.RecordBatch]:
    """(a, b, thinned, known) of rows (half's key, own, beside, node, part): the links of the one-wildcard variants of the other half.

    A pair counts once for a segment. Where many meet in a half, only a spanning forest is returned of those of different
    parts, thinned if a link was left out; known are its pairs of one part.
    """
    for key, rows in _blocks(batches):
        sig, node, part = rows[:, :2], rows[:, 2], rows[:, 3]
        half = (key >> VALUE) & (1 << TURN - VALUE) - 1
        mask, low = MASKS[half ^ 1], half & 1 == 1
        start = np.array([o for o, _ in HALVES], np.uint64)[half ^ 1]
        other = ((sig[:, 0] & mask) >> start).astype(np.int64)
        first, size = _sizes(key)
        bucket = np.repeat(np.arange(len(first)), size)
        found, large = [np.zeros((2, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        for bit in range(VALUE):
            at = np.flatnonzero(bit < np.bitwise_count(mask))
            fine = (bucket[at] << VALUE) | (other[at] & ~(1 << bit))
            order = np.argsort(fine, kind="stable")
            at, fine = at[order], fine[order]
            if not len(at):
                continue
            begin, many = _sizes(fine)
            apart = np.where(low[at] & (bit == 0), np.uint64(0), mask[at])  # equal segments meet in every variant
            big = many > SMALL
            few = np.flatnonzero(np.repeat(~big & (many > 1), many))
            found += [at[few[e]] for e in _small_links(fine[few], sig[at[few], 0], sig[at[few]], lane_bits, max_bits, apart[few])]
            for s, n in zip(begin[big].tolist(), many[big].tolist(), strict=True):
                large += [at[e + s] for e in forest(sig[at[s : s + n]], 0, lane_bits, max_bits, apart[s])]
        every, trees = np.concatenate(found, axis=1), np.concatenate(large, axis=1)
        every = every[:, part[every[0]] != part[every[1]]]
        links = np.bincount(bucket[every[0]], minlength=len(first))
        dense = (links >= DENSE) | (np.bincount(bucket[trees[0]], minlength=len(first)) > 0)
        out = [every[:, ~dense[bucket[every[0]]]]]
        thinned = [np.zeros(out[0].shape[1], bool)]
        both = np.concatenate([every, trees], axis=1)
        both = both[:, np.argsort(bucket[both[0]], kind="stable")]
        of = bucket[both[0]]
        for k in np.flatnonzero(dense).tolist():
            own = both[:, np.searchsorted(of, k) : np.searchsorted(of, k, "right")]
            ends = np.unique(own)
            ends = ends[np.argsort(node[ends])]  # one order in all buckets: their trees agree more
            edges, tree = _spanned(sig[ends], part[ends], mask[first[k]], bool(low[first[k]]), lane_bits, max_bits)
            edges, of_edge = ends[edges], tree[edges[0]]
            apart_ = part[edges[0]] != part[edges[1]]
            place = np.zeros(len(key), np.int64)
            place[ends] = tree
            count = np.bincount(place[every[0][bucket[every[0]] == k]], minlength=tree.max() + 1)
            whole = count == np.bincount(of_edge[apart_], minlength=tree.max() + 1)
            whole[place[trees[0][bucket[trees[0]] == k]]] = False
            kept = apart_ | ~whole[of_edge]
            out.append(edges[:, kept])
            thinned.append(~whole[of_edge[kept]])
        a, b = np.concatenate(out, axis=1)
        if len(a):
            ends = np.sort(np.stack([node[a], node[b]]).view(np.int64), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1]), pa.array(np.concatenate(thinned)), pa.array(part[a] == part[b])], ["a", "b", "thinned", "known"])


def _variants(name: str, lane: int = 0) -> list[Column]:
    """Keys of a fingerprint's 64 one-wildcard variants of segments."""
    variants, number = [], 0
    for offset, width in SEGMENTS:
        for bit in range(width):
            mask = ((1 << width) - 1) & ~(1 << bit)
            part = F.shiftrightunsigned(name, offset).bitwiseAND(F.lit(mask).cast("long"))
            variants.append(part.bitwiseOR(F.lit((lane << LANE) | (number << 22)).cast("long")))
            number += 1
    return variants


def signature_links(sigs: DataFrame, names: list[str], lane_bits: int, max_bits: int) -> DataFrame:
    """(a<name>.., b<name>..): links that connect exactly what all links connect; no link of the set is lost by thinning.

    sigs: distinct rows of non-null longs, one fingerprint in each column (lane). Two are linked if in some lane they share
    a one-wildcard segment and differ in at most lane_bits, and in all lanes together in at most max_bits. Rows carry their
    whole signature to the buckets, so a bucket's forest is one of verified links.
    """
    variants = [v for lane, name in enumerate(names) for v in _variants(name, lane)]
    index = sigs.select(F.explode(F.array(*variants)).alias("key"), *names)
    met = index.repartition("key").sortWithinPartitions("key", *names)  # one order in all buckets: their trees agree more
    out = [f"{side}{n}" for side in "ab" for n in names]
    return met.mapInArrow(lambda batches: _links(batches, lane_bits, max_bits, out), ", ".join(f"{c} long" for c in out)).distinct()


def _half_keys(name: str) -> list[Column]:
    """Keys of the halves of a fingerprint's segments."""
    parts = [F.shiftrightunsigned(name, offset).bitwiseAND(F.lit((1 << width) - 1).cast("long")) for offset, width in HALVES]
    return [part.bitwiseOR(F.lit(number << VALUE).cast("long")) for number, part in enumerate(parts)]


def meeting(nodes: DataFrame, lane_bits: int = 16, max_bits: int = 24, first: int = 0, last: int | None = None) -> DataFrame:
    """(a, b, thinned, known), a < b: pairs of (node, bands) that meet in a band; each band is a fingerprint of its own.

    Two meet in a band if they share a one-wildcard segment of that fingerprint and differ in at most lane_bits of it, and in
    max_bits of it and the next one (the first after the last). A wildcard is in one half of a segment, so the other half deals
    the rows, six times a band, and the 64 variants are made where they meet. Both fingerprints travel with the key, so that
    what meets by chance, whose number grows as n^2 / 2^20, isn't written.

    Of those that share a half and have many links only a forest is returned, whose pairs are thinned if it leaves out a link.
    Nodes of one part, if nodes have that column, are connected already: their links are left out, or known where a forest
    runs over them. Bands from first up to last are dealt some at a time, AT_ONCE rows or one band, and their shuffles
    deleted, so that the disk holds no more.
    """
    kinds = "a long, b long, thinned boolean, known boolean"
    rows, bands = nodes.agg(F.count("*"), F.max(F.size("bands"))).first()
    found = nodes.sparkSession.createDataFrame([], kinds)
    step = max(1, AT_ONCE // (len(HALVES) * max(rows, 1)))
    last = min(bands or 0, last or bands or 0)
    part = F.col("part" if "part" in nodes.columns else "node").alias("part")
    with shuffles_dropped(nodes.sparkSession):
        for at in range(first, last, step):
            some = nodes.select("node", part, "bands", F.posexplode(F.slice("bands", at + 1, min(step, last - at))).alias("turn", "own"))
            beside = F.element_at("bands", (F.col("turn") + (at + 1)) % bands + 1).alias("beside")
            index = some.select(F.explode(F.array(*_half_keys("own"))).alias("key"), "turn", "own", beside, "node", "part")
            met = index.select(F.shiftleft(F.col("turn").cast("long"), TURN).bitwiseOR(F.col("key")).alias("key"), "own", "beside", "node", "part")
            dealt = met.repartition("key").sortWithinPartitions("key")
            pairs = dealt.mapInArrow(lambda batches: _half_links(batches, lane_bits, max_bits), kinds)
            found = found.unionByName(durable(pairs.groupBy("a", "b").agg(F.max("thinned").alias("thinned"), F.min("known").alias("known"))))
    return found


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links that connect exactly what all links at max_bits or fewer differing bits connect.

    fps: distinct non-null fp longs. max_bits up to 5 keeps the pigeonhole (three segments, at most one bit in one).
    """
    if max_bits // len(SEGMENTS) > 1:
        raise ValueError("three segments guarantee a one-bit segment up to 5 differing bits")
    return signature_links(fps, ["fp"], max_bits, max_bits).select(F.col("afp").alias("a"), F.col("bfp").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(id, fp, component_id): one row per input row; component_id is the smallest id reachable over links.

    Equal fingerprints (all texts without a word have 0) are linked. A row of null id takes part and gets the component
    of its fingerprint, null where no row of it has an id. Repeated rows give repeated results. Links are found between
    distinct fingerprints; copies are never expanded into pairs. Extra columns are ignored.
    """
    marked = durable(fingerprints(docs, id_col, text_col, shingle))
    distinct = durable(marked.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    # every fingerprint has a class; few classes have more than one
    rooted = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """16 lower-case hex digits of a long column."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def close(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b), a < b: nodes that connect all of (node, fp) whose fingerprints are equal or linked (see links).

    A node may have several fingerprints: texts of one set of shingles that repeat them differently.
    """
    heads = durable(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.select("node", "fp").join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    one, two = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    linked = links(heads.select("fp"), max_bits).join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return durable(equal.unionByName(linked).where("a <> b"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """(id, key, component_id), one row per input row of non-null id; key is minhash.row_key of its text."""
    marked = durable(minhash.nodes_of(docs, id_col, text_col, shingle, similarity))
    nodes = marked.groupBy("node").agg(F.min(F.struct("id", "key")).alias("own"), F.first("bands").alias("bands"))
    nodes = durable(nodes.select("node", "own.*", "bands"))
    near = close(durable(marked.where(F.col("node") != minhash.WORDLESS).select("node", "fp").distinct()))
    own = near.select("a", "b", F.lit(False).alias("thinned"), F.lit(False).alias("known"))
    met = durable(own.unionByName(meeting(nodes, last=FIRST)))
    linked = minhash.verified(docs, id_col, text_col, shingle, similarity, nodes, met)
    joined = nodes.join(sized(components(linked)), "node", "left").select("node", "bands", F.coalesce("root", "node").alias("part"))
    more = durable(meeting(durable(joined), first=FIRST))  # what the first links connect needn't meet again
    linked = linked.unionByName(minhash.verified(docs, id_col, text_col, shingle, similarity, nodes, more))
    trees = met.unionByName(more).where("thinned").select("a", "b")
    found = components(minhash.settled(docs, id_col, text_col, shingle, similarity, nodes, trees, linked))
    rooted = nodes.select("node", "id").join(sized(found), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = rooted.select("node", "root").join(least, "root")
    return marked.select("id", "key", "node").join(classes, "node").select("id", "key", "component_id")


def resembling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id), one row per input row of non-null id: groups linked by pairs of the given shingle Jaccard or more.

    Jaccard is that of the sets of distinct word shingles. Candidates are the links of the texts' fingerprints at four bits
    (see links). As pairs at a Jaccard of 0.8 mostly lie further apart, more fingerprints are drawn from the sets, the bands,
    and those that meet in one by the same variants are candidates too (see meeting); every link is verified over both sets
    (see minhash). Texts without a word resemble each other.
    """
    return _grouped(docs, id_col, text_col, shingle, similarity).select("id", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The input rows less all but one of each group of resembling texts: the smallest id stays.

    Rows are removed by id and text, so of an id that is repeated with several texts each stands for itself. Texts without
    a word, null ones among them, resemble each other. Rows of null id are kept, for they can't be told apart; of repeated
    rows of the id that stays, the repetitions stay too. An empty table stays empty; columns of any name pass through.
    """
    grouped = _grouped(docs, id_col, text_col, shingle, similarity)
    own, row_key = unused(docs, "__gone"), unused(docs, "__key")
    gone = grouped.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(own), F.col("key").alias(row_key)).distinct()
    same = (F.col(f"`{id_col}`") == F.col(own)) & (minhash.row_key(F.col(f"`{text_col}`")) == F.col(row_key))
    return docs.join(sized(gone), same, "left_anti")
