"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Base spans come from four patterns. Each distinct value found is a protected entity. Over all documents, the words of
those that hold a value (or, with a window, the words near it) are counted with it: with N documents, IC(e) =
log2(N / n(e)) is what knowing the entity tells, and PMI(e, t) = log2(N n(e, t) / (n(e) n(t))) what the term t tells
about it. A term with PMI >= IC / alpha, seen with the entity in min_support documents or more, discloses it: in the documents that hold the entity its occurrences are spans of
kind "term", which sanitize() removes, while the values themselves are generalised to the name of their kind.

Patterns are written with possessive groups and run starts so that they are linear in the length of the text; they match
exactly what the plain forms match from left to right:
  email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+     ip [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts <= 255
  card [0-9]([\\x20-]?[0-9])+, 12 to 19 digits, Luhn            phone \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, measured, sized, unused

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERN = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
PART = 256  # spans added to an array one by one
PIECE = 1024  # code points
WINDOW = 64  # code points on either side of a value
SPAN = "struct<s:int,e:int,k:int,v:string>"
WORD = r"[\p{L}\p{N}]++"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """True where the digits of v pass the Luhn test."""
    back = F.reverse(_digits(v))
    d = F.transform(F.sequence(F.lit(1), F.length(back)), lambda i: back.substr(i, F.lit(1)).cast("int") * (2 - i % 2))
    total = F.aggregate(d, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    n = F.length(_digits(v))
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return ~F.exists(F.split(v, r"\."), lambda p: (F.length(part(p)) > 3) | (F.lpad(part(p), 3, "0") > "255"))
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(v)).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["v"])


def _of(kind: int) -> Callable[[Column], Column]:
    return lambda x: x["k"] == kind


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(values: Column) -> Column:
    """An array cut into parts of PART: adding to an array copies it, so long ones are built from parts."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / PART), F.lit(0)).cast("int")), lambda i: F.slice(values, i * PART + 1, F.lit(PART)))


def _found(text: Column, pattern: Column, here: Column, kind: int) -> Column:
    """All leftmost non-overlapping matches as spans in code points, end exclusive."""
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["v"])
        span = F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("k"), x["v"].alias("v"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(parts: Column) -> Column:
        """Spans of all parts, from those whose places count from the beginning of their part."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(parts, zero, lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        moved = lambda x, at: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["k"].alias("k"), x["v"].alias("v"))
        return F.flatten(F.zip_with(parts, begins, lambda p, at: F.transform(p["out"], lambda x: moved(x, at))))

    pairs = F.zip_with(hits, gaps, lambda v, g: F.struct(F.length(g).alias("g"), v.alias("v")))
    pairs = F.filter(pairs, lambda x: x["v"].isNotNull())
    every = _with(pairs, lambda p: _with(F.transform(_parts(p), lambda part: F.aggregate(part, start, step)), placed))
    return F.when(here & F.regexp_like(text, pattern), every).otherwise(empty)


def _ordered(spans: Column) -> Column:
    """By start, then kind as listed."""
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["k"], x["e"], x["v"])))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def base_spans(docs: DataFrame, text_col: str = "text", out: str = "__spans") -> DataFrame:
    """The rows with an array of base spans (s, k, e, v), by start then kind. Null text: no spans."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    raw = []
    for i, kind in enumerate(KINDS):
        here = F.contains(text, F.lit(HINT[kind])) if HINT[kind] else F.lit(True)
        pattern = PATTERN[kind]
        if kind == "card":  # what is too short to be a card never passes: look for runs of twelve digits first
            here = F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))
        raw.append(F.filter(_found(text, F.lit(pattern), here, i), _passes(kind)))
    return docs.withColumn(out, _ordered(F.concat(*raw)))


def _entity(span: Column) -> Column:
    """A value in the form in which equal entities are equal."""
    value = F.when(span["k"] == 0, F.lower(span["v"])).when(span["k"] == 1, span["v"]).otherwise(_digits(span["v"]))
    return F.concat_ws(":", span["k"], value)


def _near(pieces: Column, span: Column, window: int) -> Column:
    """Distinct words, lower-cased, within the window on either side of a span; words cut by the window are left out.

    pieces: the text in pieces of PIECE code points, as looking for a place in a long text takes as long as the text is.
    """

    def cut(at: Column, n: Column) -> Column:
        piece = F.floor(at / PIECE).cast("int")
        both = F.concat(F.coalesce(F.get(pieces, piece), F.lit("")), F.coalesce(F.get(pieces, piece + 1), F.lit("")))
        return F.substring(both, at - piece * PIECE + 1, n)

    before = cut(F.greatest(F.lit(0), span["s"] - window), F.least(span["s"], F.lit(window)))
    before = F.when(span["s"] > window, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
    after = cut(span["e"], F.lit(window))
    after = F.when(F.length(after) == window, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
    words = F.concat(F.regexp_extract_all(before, F.lit(WORD), F.lit(0)), F.regexp_extract_all(after, F.lit(WORD), F.lit(0)))
    return F.array_distinct(F.transform(words, F.lower))


def _words(text: Column) -> Column:
    """Distinct words of a text, lower-cased."""
    return F.array_distinct(F.transform(F.split(text, r"[^\p{L}\p{N}]+"), F.lower))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.25, min_support: int = 3, window: int | None = WINDOW) -> DataFrame:
    """(id, row_key, base, spans), one row per input row: base spans, and all spans with the disclosing terms.

    row_key is a hash of id and text, and rows are told apart by id and row_key; rows equal in both have equal results. Each row counts as a document. A term that
    overlaps a base span is left to it. window: the code points on either side of a value in which terms are sought; None: all
    words of the document, those of the value included, so that n(e, t) and n(t) count the same words. Null and empty
    texts have no spans, and rows of null id take part like others. An empty table gives an empty result. Extra columns
    are ignored.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    narrow = narrow.withColumn("row_key", F.xxhash64("id", "text"))
    spans = base_spans(narrow)
    nothing = F.array().cast("array<string>")
    if window is None:
        context = F.transform(F.array_distinct(F.transform("__spans", _entity)), lambda x: F.struct(x.alias("entity"), nothing.alias("terms")))
    else:
        pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int")), lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)))
        context = _with(pieces, lambda p: F.array_distinct(F.transform("__spans", lambda x: F.struct(_entity(x).alias("entity"), _near(p, x, window).alias("terms")))))
        context = F.when(F.size("__spans") > 0, context)
        if window > PIECE:
            raise ValueError(f"a window has at most {PIECE} code points")
    held_words = F.when(F.size("__spans") > 0, F.array_remove(_words(F.col("text")), "")) if window is None else nothing
    # the row number is settled by the checkpoint
    base = durable(spans.select("id", "row_key", F.monotonically_increasing_id().alias("row"), F.col("__spans").alias("base"), context.alias("context"), held_words.alias("words")))

    met = base.where(F.size("base") > 0).select("row", "id", "row_key", "words", F.explode("context").alias("c")).select("row", "id", "row_key", "words", "c.*")
    held = met.groupBy("entity").agg(F.count_distinct("row").alias("n_e")).where(F.col("n_e") >= min_support)
    if window is None:  # each row has an entity and a word once
        pairs = met.join(sized(held), "entity").select("entity", "n_e", F.explode("words").alias("term"))
    else:
        pairs = met.join(held, "entity").select("entity", "n_e", "row", F.explode("terms").alias("term")).distinct()
    pairs = durable(pairs.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= min_support))
    terms, few = measured(pairs.select("term").distinct())
    words = narrow.select(F.explode(_words(F.col("text"))).alias("term"))
    if few:  # else words are counted where they are before any is moved
        words = words.join(F.broadcast(terms), "term")
    spread = words.groupBy("term").agg(F.count("*").alias("n_t"))
    total = float(max(1, base.count()))
    pmi = F.log2(F.lit(total) * F.col("n_et") / (F.col("n_e").cast("double") * F.col("n_t")))
    ic = F.log2(F.lit(total) / F.col("n_e"))
    disclosing = pairs.join(spread, "term").where((pmi >= ic / alpha) & (pmi > 0)).select("entity", "term")

    if window is None:
        told = met.select("id", "row_key", "entity", F.explode("words").alias("term")).join(sized(disclosing), ["entity", "term"])
    else:
        told = met.join(disclosing, "entity")
    marked = sized(told.groupBy("id", "row_key").agg(F.collect_set("term").alias("terms")))
    same = lambda other: F.col("d.id").eqNullSafe(F.col(f"{other}.id")) & (F.col("d.row_key") == F.col(f"{other}.row_key"))
    texts = narrow.alias("d").join(marked.alias("m"), same("m")).select("d.id", "d.row_key", "d.text", "terms").dropDuplicates(["id", "row_key"])
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.array_sort("terms"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    added = texts.select("id", "row_key", _found(F.col("text"), pattern, F.lit(True), len(KINDS)).alias("added"))
    clear = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    joined = base.select("id", "row_key", "base").alias("d").join(added.alias("a"), same("a"), "left").select("d.id", "d.row_key", "base", "added")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.filter(_ordered(F.col("added")), clear))))
    return joined.select("id", "row_key", "base", every.alias("spans"))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 1.25, min_support: int = 3, window: int | None = WINDOW) -> DataFrame:
    """The input rows with every base span generalised to [EMAIL], [IP], [CARD] or [PHONE] and disclosing terms removed.

    Spans of different kinds that overlap become one, of the kind that starts first. Rows without spans stay as they are,
    null and empty texts among them. Rows of null id are sanitised like others, repeated rows alike. Columns of any name
    pass through.
    """
    mine = {c: unused(docs, f"__{c}") for c in ("id", "row_key", "spans", "whole")}
    own, row_key, spans, whole_out = mine.values()
    found = find(docs, id_col, text_col, alpha, min_support, window).where(F.size("spans") > 0)
    found = sized(found.select(*[F.col(c).alias(mine[c]) for c in ("id", "row_key", "spans")]).dropDuplicates([own, row_key]))
    span = "struct<s:int,k:int,e:int>"

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        plain = F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))
        longer = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] > x["s"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(plain)))

    def joined(acc: Column, part: Column) -> Column:
        """Merged spans so far and those of the next part, of which the first may begin within the last so far."""
        last = F.element_at(acc, -1)
        end = F.greatest(last["e"], F.coalesce(F.array_max(F.transform(F.filter(part, lambda x: x["s"] < last["e"]), lambda x: x["e"])), last["e"]))
        longer = F.struct(last["s"].alias("s"), last["k"].alias("k"), end.alias("e"))
        return F.when((F.size(acc) > 0) & (F.size(part) > 0), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer), F.filter(part, lambda x: x["s"] >= last["e"]))).otherwise(F.concat(acc, part))

    text = F.col(f"`{text_col}`")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))
    none = F.array().cast(f"array<{span}>")
    whole = F.aggregate(F.transform(_parts(F.col(spans)), lambda part: F.aggregate(part, none, merge)), none, joined)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(own)) & (F.xxhash64(F.col(f"`{id_col}`"), text) == F.col(row_key))
    keyed = docs.join(found, same, "left").withColumn(whole_out, whole)
    begins = F.concat(F.array(F.lit(0)), F.transform(F.slice(whole_out, 1, F.greatest(F.size(whole_out) - 1, F.lit(0))), lambda x: x["e"]))
    parts = F.zip_with(whole_out, begins, lambda x, at: F.concat(F.substring(text, at + 1, x["s"] - at), F.element_at(labels, x["k"] + 1)))
    clean = F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(whole_out, -1)["e"] + 1, F.length(text)))
    return keyed.select(*[F.when(F.size(whole_out) > 0, clean).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans, and all spans as text."""
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
