import random

from concord.llm import urlfilter
from concord.llm.queries import ALLOW, BLOCK


def plain(url, allow=ALLOW, block=BLOCK):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, rules in (("block", block), ("allow", allow)) for h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_rules_against_loops(spark):
    rng = random.Random(2)
    bits = ["example", ".", "com", "net", "org", "/", "en", "de", "es", "7", "8", "?", "#", "://", "COM", "é", "\n", ":80", "u@"]
    urls = ["http://" + "".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(1500)]
    urls += ["http://example.com/en/742", "http://a.b.example.com/en/8", "x.net/de/8", None, "", "://", "http://net/de/8", "HTTP://EXAMPLE.NET/de/81?x", "http://" + "a." * 20_000 + "com/en/" + "x" * 50_000]
    urls += urls[:20]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, ALLOW, BLOCK).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    assert urlfilter.judge(pages.limit(0), ALLOW, BLOCK).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(pages, [], []).collect()} == {"allow"}


def test_a_tie_goes_to_the_longer_host(spark):
    urls = ["http://a.com/x", "http://a.com/y", "http://b.com/x", "http://q.a.com/xyz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    allow, block = [("a.com", "")], [("com", "/x")]
    got = {r["id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(pages, allow, block).collect()}
    assert got == {i: plain(u, allow, block)[2:] for i, u in enumerate(urls)}
    assert got[0] == ("a.com", "allow") and got[2] == ("com/x", "block")


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(40_000).selectExpr("cast(id as string) key")
    listed = spark.range(0, 40_000, 13).selectExpr("cast(id as string) key")
    cascade = urlfilter.build(universe, listed)
    assert len(cascade.levels) > 2
    hashed = universe.selectExpr("key", "xxhash64(key) h1", "xxhash64('second', key) h2").toPandas()
    held = cascade.holds(hashed["h1"].to_numpy(), hashed["h2"].to_numpy())
    assert (held == (hashed["key"].astype(int) % 13 == 0).to_numpy()).all()
