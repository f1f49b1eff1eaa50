import hashlib
import math
import random
import re
from collections import defaultdict

from concord.llm import pii

DATA = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def plain_spans(text):
    found = [(m.start(), k, m.end(), m[0]) for k, kind in enumerate(PLAIN) for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m[0])]
    return sorted(found)


def plain_find(rows, alpha=1.25, support=3):
    """Spans of every row by loops over the definition."""
    base = [plain_spans(t) for _, t in rows]
    n_e, n_et, n_t, of = defaultdict(set), defaultdict(set), defaultdict(int), defaultdict(set)
    for i, (_, t) in enumerate(rows):
        for s, k, e, v in base[i]:
            entity = (k, v.lower() if k == 0 else v if k == 1 else re.sub("[^0-9]", "", v))
            n_e[entity].add(i)
            of[i].add(entity)
            before, after = t[max(0, s - 64) : s], t[e : e + 64]
            before = re.sub(r"^[^\W_]+", "", before) if s > 64 else before
            after = re.sub(r"[^\W_]+$", "", after) if len(after) == 64 else after
            for w in re.findall(r"[^\W_]+", before) + re.findall(r"[^\W_]+", after):
                n_et[entity, w.lower()].add(i)
        for w in {w.lower() for w in re.findall(r"[^\W_]+", t or "")}:
            n_t[w] += 1
    out, n = [], len(rows)
    for i, (d, t) in enumerate(rows):
        terms = {w for (e, w), at in n_et.items() if e in of[i] and len(at) >= support and 0 < (p := math.log2(n * len(at) / (len(n_e[e]) * n_t[w]))) and p >= math.log2(n / len(n_e[e])) / alpha - 1e-12}
        more = [(m.start(), 4, m.end(), m[0]) for m in re.finditer(r"[^\W_]+", t or "") if m[0].lower() in terms and not any(b[0] < m.end() and m.start() < b[2] for b in base[i])]
        out.append((d, base[i], sorted(base[i] + more)))
    return out


def told(spans):
    return ",".join(f"{(*PLAIN, 'term')[k]}:{s}:{e}" for s, k, e, _ in spans)


def compare(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "id long, text string, base string")
    got = sorted((str(r["doc_id"]), r["base_sha256"], r["spans"], r["n_email"], r["n_card"]) for r in pii.digest(pii.find(docs, "id")).collect())
    want = sorted((str(d), hashlib.sha256(told(b).encode()).hexdigest(), told(a), sum(x[1] == 0 for x in b), sum(x[1] == 2 for x in b)) for d, b, a in plain_find(rows))
    assert got == want
    return docs, want


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    _, want = compare(spark, rows)
    assert sum(bool(x[2]) for x in want) > 10


def test_random_fragments(spark):
    rng = random.Random(3)
    bits = ["a", "Z", "9", "0", "4111111111111111", "4111 1111-1111 1111", "@", ".", "-", "+", "_", "%", " ", "  ", "(", ")", "255", "256", "1.2.3.4", "x@y.zz", "é", "😀", "\n", "+1 (456) 555-2186", "@a.b", "c.d"]
    compare(spark, [(i, "".join(rng.choices(bits, k=rng.randint(1, 25)))) for i in range(3000)])


def test_disclosing_terms_and_sanitised_text(spark):
    rows = [(i, f"agent zorro writes {'x' * 70} from a@b.co") for i in range(4)] + [(10 + i, f"code name Vesper: call a@b.co vesper, {i}") for i in range(4)] + [(20 + i, f"the code name of agent {i}, call back") for i in range(9)]
    docs, want = compare(spark, rows)
    assert any("term" in x[2] for x in want)
    clean = {r["id"]: r["text"] for r in pii.sanitize(docs, "id").collect()}
    assert clean[10] == "code name : call [EMAIL] , 0" and clean[20] == rows[8][1]
    assert not any("@" in t for t in clean.values())


def test_edges(spark):
    rows = [(None, None), (1, ""), (1, "a@b.cd"), (1, "a@b.cd"), (2, "9" * 3000), (3, "a" * 3000), (4, "1 " * 100_000), (5, "+1" + " " * 100_000), (6, "a@b" + ".c" * 50_000), (7, "a@b.c " * 2000), (8, "+1 (456) 555-2186@x.yz")]
    docs, _ = compare(spark, rows)
    out = pii.sanitize(docs, "id")
    assert out.columns == docs.columns and out.count() == len(rows)
    assert pii.find(docs.limit(0), "id").count() == 0 and pii.sanitize(docs.limit(0), "id").count() == 0
    assert {r["text"] for r in out.where("id = 8").collect()} == {"[PHONE]"}
    long = spark.createDataFrame([(2, "9" * 500_000), (3, "a" * 500_000 + "@"), (4, "1." * 200_000)], "id long, text string")
    assert [r["spans"] for r in pii.digest(pii.find(long, "id")).orderBy("doc_id").collect()][:2] == ["", ""]
