import math
import re
from collections import defaultdict

import corpus_pipeline as cp
from concord.llm import pii, queries

from .test_pii import plain_spans

DATA = "/root/testdata/sf0.01"


def plain_terms(rows, alpha=1.25, support=3):
    """The spans of plain_documents() as text."""
    return [(d, ",".join(f"{(*pii.KINDS, 'term')[k]}:{s}:{e}" for s, k, e, _ in spans)) for d, spans in plain_documents(rows, alpha, support)]


def plain_documents(rows, alpha=1.25, support=3):
    """Base spans and those of disclosing terms, with terms counted over whole documents."""
    base, words = [plain_spans(t) for _, t in rows], [[(m.start(), 4, m.end(), m[0]) for m in re.finditer(r"[^\W_]+", t or "")] for _, t in rows]
    of = [{(k, v.lower() if k == 0 else v if k == 1 else re.sub("[^0-9]", "", v)) for _, k, _, v in b} for b in base]
    n_e, n_t, n_et = defaultdict(int), defaultdict(int), defaultdict(int)
    for held, w in zip(of, words, strict=True):
        own = {x[3].lower() for x in w}
        for t in own:
            n_t[t] += 1
        for e in held:
            n_e[e] += 1
            for t in own:
                n_et[e, t] += 1
    terms, n = defaultdict(set), len(rows)
    for (e, t), both in n_et.items():
        if both >= support and 0 < (p := math.log2(n * both / (n_e[e] * n_t[t]))) and p >= math.log2(n / n_e[e]) / alpha - 1e-12:
            terms[e].add(t)
    out = []
    for (d, _), b, held, w in zip(rows, base, of, words, strict=True):
        mine = set().union(*[terms[e] for e in held]) if held else set()
        more = [x for x in w if x[3].lower() in mine and not any(y[0] < x[2] and x[0] < y[2] for y in b)]
        out.append((d, sorted(b + more)))
    return out


def test_query_counts_whole_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = [(r["doc_id"], r["spans"]) for r in queries.op1_pii_disclosure(spark, DATA).collect()]
    assert sorted(got) == sorted(plain_terms(rows))


def test_a_term_far_from_the_value_is_removed(spark):
    rows = [(i, f"Zorro writes {'x ' * 90}to a@b.co", "en", "s", 0) for i in range(4)] + [(20 + i, f"x writes to agent {i}", "en", "s", 0) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in cp.personal_data(spark, docs, "").collect()}
    assert not any("Zorro" in t or "@" in t for t in got.values()) and got[20] == rows[4][1]
