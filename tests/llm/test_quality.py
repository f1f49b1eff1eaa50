import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from concord.llm import quality

DATA = "/root/testdata/sf0.01"
SPACE = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines, dup, earlier = text.split("\n"), 0, set()
    for line in lines:
        if re.search(SPACE, line):
            dup += line in earlier
            earlier.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_counts_and_distances_against_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ref = quality.learn(docs)
    got = {r["id"]: r for r in quality.judge(docs, ref).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    words = {lang: Counter() for lang in ref.words}
    for r in rows:
        words[r["lang"]].update(w.lower() for w in r["text"].encode().split())
    for lang, c in words.items():
        size = sum(c.values())
        assert set(ref.words[lang]) == {w for w, n in c.items() if n >= 0.002 * size}
        np.testing.assert_allclose([ref.shares[lang][i] for i in ref.words[lang].values()], [c[w] / size for w in ref.words[lang]])
        np.testing.assert_allclose(ref.shares[lang].sum(), 1)
    for r in rows:
        g = got[r["doc_id"]]
        *counts, failed = plain(r["text"])
        assert [g[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == counts and g["base_failed"] == failed
        if counts[0] >= 50:
            bins, mine = ref.words[r["lang"]], [0] * len(ref.shares[r["lang"]])
            for w in r["text"].encode().split():
                mine[bins.get(w.lower(), len(mine) - 1)] += 1
            assert abs(js([n / counts[0] for n in mine], ref.shares[r["lang"]]) - g["word_js"]) < 1e-6
        assert g["kept"] == (not failed and g["char_js"] <= 0.28 and g["word_js"] <= 0.45)


def test_every_common_word_is_among_the_candidates(spark):
    rng = np.random.default_rng(2)
    texts = {lang: [" ".join(f"{lang}{min(int(x), 50_000)}" for x in rng.zipf(1.3, 4000)) for _ in range(n)] for lang, n in (("aa", 150), ("bb", 1))}
    docs = spark.createDataFrame([(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, text string, lang string")
    ref = quality.learn(docs)
    assert set(ref.words) == {"aa", "bb"}  # a language of one document in 151 has its reference
    for lang, ts in texts.items():
        c = Counter(w.encode() for t in ts for w in t.split())
        assert set(ref.words[lang]) == {w for w, n in c.items() if n >= 0.002 * sum(c.values())}
    lists = list(quality._candidates(iter([pa.RecordBatch.from_arrays([pa.array(["aa"] * 150), pa.array([t.encode() for t in texts["aa"]])], ["lang", "data"])]), 0.002))
    assert len(lists) == 1 and 500 < lists[0].num_rows <= 2001


def test_edges(spark):
    normal = "the cat sat on a mat and the dog ran to it while we saw " * 3
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, normal, "en", "a"), (3, normal, "en", "a"), (None, "x" * 50_000, "en", None), (5, "a b " * 50_000, None, "b"), (6, "&%$ " * 100, "zz", "b"), (7, "one\n\none\none \n", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    got = quality.judge(docs, quality.learn(docs)).collect()
    assert len(got) == 8
    by = {r["id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[1]["base_failed"] and not by[1]["kept"]
    assert by[5]["n_repeat_words"] == 100_000 and by[7]["n_dup_lines"] == 1
    for r in got:
        text = next(t for d, t, *_ in rows if d == r["id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(text)
    empty = docs.limit(0)
    assert quality.judge(empty, quality.learn(empty)).count() == 0
    assert quality.judge(docs, quality.learn(empty)).count() == 8
