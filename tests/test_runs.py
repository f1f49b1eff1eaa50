import json
import zipfile

import pytest
from pyspark.sql import functions as F

from concord.__main__ import main
from concord.functions.similarity import tags
from concord.operators import audit, blocking, ordering, scoring, validate
from concord.plans import runs
from concord.sources import tables

S1 = [("S1-1", "Kiln & Daughters", "7 Quay", "Peru"), ("S1-2", "Heron Boats", "31 Mill Lane", "Kenya"), ("S1-3", None, None, "Nepal"), ("S1-4", "Lark", "9 Hill", "Peru"), ("S1-5", "Otter, Press", "2 Weir", "Norway")]
S2 = [("S2-1", "KILN and Daughters", "7 Quay", "Peru"), ("S2-2", "Heron Boats", "31 Mill Lane", "Japan"), ("S2-3", None, None, "Nepal"), ("S2-4", "Heron Boats", "13 Mill Lane", "Kenya")]
S3 = [("S3-1", "Kiln and Daughters", "7 Quay", None), ("S3-2", "OTTER PRESS", "2 Weir", "Norway")]
TRUTH = [("S1-1", "S2-1,S3-1"), ("S1-2", "S2-4"), ("S1-3", None), ("S1-4", None), ("S1-5", "S3-2")]


def put(path, columns, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join("\t".join(x or "" for x in r) for r in [columns, *rows]) + "\n", encoding="utf-8")


@pytest.fixture
def root(tmp_path):
    for split in ("train", "test"):
        for i, rows in enumerate((S1, S2, S3), 1):
            shifted = rows if split == "train" else [(r[0].replace("-", "-t"), *r[1:]) for r in rows]
            put(tmp_path / "dataset" / split / f"{split}_source{i}.tsv", tables.SOURCE_COLUMNS, shifted)
    put(tmp_path / "dataset/train/train_ground_truth.tsv", tables.TRUTH_COLUMNS, TRUTH)
    return tmp_path


def test_audit_and_baseline(spark, root):
    report = runs.audit(spark, str(root))
    assert set(report["integrity"].values()) == {0} and report["sources"]["train_source2"]["business_name_missing"] == 1
    result = runs.baseline(spark, str(root))
    assert result["overall"]["macro_f05"] == pytest.approx(0.8) and result["overall"]["candidate_pairs"] == 4
    got = {r["sid"]: r["ids"] for r in tables.read_results(spark, str(root / "output/matching_results.tsv")).collect()}
    assert got == {"S1-t1": ["S2-t1", "S3-t1"], "S1-t2": [], "S1-t3": [], "S1-t4": [], "S1-t5": ["S3-t2"]}
    wide = {r["sid"]: r["ids"] for r in tables.read_results(spark, str(root / "output/candidate_pairs.tsv"), "candidate_entity_ids").collect()}
    assert wide["S1-t2"] == ["S2-t2"] and all(set(got[s]) <= set(wide[s]) for s in got)
    assert (root / "output/matching_results.tsv").read_text().splitlines()[2] == "S1-t2\t"
    runs.baseline(spark, str(root))
    assert len((root / "experiments/results.csv").read_text().splitlines()) == 3
    assert sorted((root / "experiments/folds.tsv").read_text().splitlines())[-1].startswith("source1")
    sample = runs.positive_sample(spark, str(root))
    assert sample["sample_size"] == 4 and sample["tags"]["near_exact"] == 3


def test_baseline_needs_a_clean_audit(spark, root):
    with pytest.raises(ValueError, match="audit"):
        runs.baseline(spark, str(root))
    put(root / "dataset/train/train_ground_truth.tsv", tables.TRUTH_COLUMNS, [*TRUTH, ("S1-9", "S2-77")])
    with pytest.raises(ValueError, match="unknown_truth"):
        runs.audit(spark, str(root))
    assert json.loads((root / "reports/data_audit.json").read_text())["integrity"]["unknown_truth_targets"] == 1
    with pytest.raises(ValueError, match="resolve"):
        runs.baseline(spark, str(root))


def test_entity_scores_equal_the_set_formula(spark):
    first = spark.createDataFrame(S1, ", ".join(f"{c} string" for c in tables.SOURCE_COLUMNS))
    links = tables.links_of(spark.createDataFrame(TRUTH, "source1_entity_id string, matched_entity_ids string"))
    cand = spark.createDataFrame([("S1-1", "S2-1", True), ("S1-1", "S3-1", True), ("S1-2", "S2-2", False)], "sid string, tid string, accepted boolean")
    assert {r["sid"]: r["f05"] for r in scoring.entity_scores(first, links, cand).collect()} == {"S1-1": 1, "S1-2": 0, "S1-3": 1, "S1-4": 1, "S1-5": 0}


def evaluated(spark, truth, predicted):
    table = lambda d: spark.createDataFrame(list(d.items()), "sid string, ids array<string>")
    return scoring.evaluate(table(truth), table(predicted))


def test_evaluate(spark):
    assert evaluated(spark, {"a": ["S2-5", "S3-9"]}, {"a": ["S2-5", "S3-9", "S2-6"]})["macro_f05"] == pytest.approx(5 / 7)
    for t, p, want in (([], [], 1), ([], ["x"], 0), (["x"], [], 0), (["x"], ["x"], 1)):
        assert evaluated(spark, {"a": t}, {"a": p})["macro_f05"] == want
    mixed = evaluated(spark, {"a": [], "b": ["x", "y"]}, {"a": [], "b": ["x"]})
    assert mixed["macro_f05"] == pytest.approx((1 + 5 / 6) / 2) and mixed["singleton_fp_rate"] == 0
    with pytest.raises(ValueError):
        evaluated(spark, {"a": [], "b": []}, {"a": []})
    with pytest.raises(ValueError):
        evaluated(spark, {}, {})


def test_strict_reading(spark, tmp_path):
    path = tmp_path / "x.tsv"
    put(path, tables.SOURCE_COLUMNS, [('S1-1', '"Quoted" Shop', '"a\tb"', "")])
    assert tables.read_tsv(spark, str(path), tables.SOURCE_COLUMNS).first()["business_address"] == "a\tb"
    put(path, ("entity_id", "name", "business_address", "country"), [])
    with pytest.raises(tables.SchemaError):
        tables.read_tsv(spark, str(path), tables.SOURCE_COLUMNS)
    put(path, tables.SOURCE_COLUMNS, [("S1-1", "short")])
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_tsv(spark, str(path), tables.SOURCE_COLUMNS).collect()
    path.write_bytes(b"entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t\xff\xfe\tb\tc\n")
    with pytest.raises(tables.SchemaError, match="UTF-8"):
        tables.read_tsv(spark, str(path), tables.SOURCE_COLUMNS)
    for rows in ([("a", "x,x")], [("a", "x"), ("a", "y")]):
        put(path, tables.TRUTH_COLUMNS, rows)
        with pytest.raises(tables.SchemaError, match="duplicate"):
            tables.read_results(spark, str(path))


def findings(spark, root, matching, candidate=None, **options):
    (root / "output").mkdir(exist_ok=True)
    paths = []
    for name, text in (("m.tsv", matching), ("c.tsv", candidate)):
        paths.append(str(root / "output" / name))
        if text is not None:
            (root / "output" / name).write_bytes(text.encode("utf-8", "surrogateescape"))
    return {r["rule"]: (r["severity"], r["offenders"], r["examples"]) for r in validate.validate(spark, paths[0], paths[1], str(root / "dataset/test"), **options).collect()}


def test_validator_rules(spark, root):
    head = "source1_entity_id\tmatched_entity_ids\n"
    sound = head + "S1-t1\tS2-t1,S3-t1\nS1-t2\t\n\nS1-t3\t\nS1-t4\t \nS1-t5\t\n"
    assert findings(spark, root, sound, sound.replace("matched", "candidate"), check_ids=True) == {}
    bad = head + "S1-t1\tS2-t1,S2-t1\nS1-t1\tS1-t1,X9\nno tab\nS1-t2\tS2-none\nS1-zz\t\n"
    got = findings(spark, root, bad, "source1_entity_id\tcandidate_entity_ids\nS1-t1\t\nS1-t2\t\nS1-t3\t\nS1-t4\t\nS1-t5\t\n", check_ids=True)
    want = {"malformed_row": ["4"], "duplicate_row": ["S1-t1"], "repeated_id": ["S1-t1"], "self_match": ["S1-t1"], "wrong_prefix": ["X9"], "unknown_id": ["S2-none"], "missing_s1": ["S1-t3", "S1-t4", "S1-t5"], "unknown_s1": ["S1-zz"]}
    assert {k: v[2] for k, v in got.items() if v[0] == "error"} == want
    assert got["match_not_candidate"][0] == "warning"
    assert set(findings(spark, root, "a,b\nS1-t1,S2-t1\n", check_ids=True)) >= {"comma_separated"}
    assert set(findings(spark, root, "x\ty\n", check_ids=True)) >= {"unexpected_header"}
    assert set(findings(spark, root, "", check_ids=True)) >= {"file_empty"}
    assert findings(spark, root, head + "S1-t1\t\udcff\n", check_ids=True)["not_utf8"][0] == "fatal"
    (root / "dataset/test/test_source3.tsv").unlink()
    assert findings(spark, root, sound, check_ids=True)["targets_missing"][0] == "warning"
    (root / "dataset/test/test_source1.tsv").unlink()
    assert set(findings(spark, root, sound)) == {"file_missing"}


def test_tags(spark):
    pairs = [("acme inc", "5 main st", "acme ltd", "5 main street"), ("a b", "x y", "b a", "x y"), ("delhi", "q", "दिल्ली", "q"), ("abcd", "1 long street name", "wxyz", "1 long street name"), ("same name", "zz", "same name", "qq"), ("ab", "cd", "xy", "zw"), ("same", "road", "same", "road"), ("abcdef", "ghijklmn", "abcxyz", "ghijzzzz")]
    df = spark.createDataFrame(pairs, "a string, x string, b string, y string")
    got = [r[0] for r in df.select(tags(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()]
    assert "suffix_variation" in got[0] and "address_abbreviation" in got[0] and "token_reorder" in got[1]
    assert "possible_transliteration" in got[2] and "weak_name_strong_address" in got[3] and "strong_name_weak_address" in got[4]
    assert got[5] == "possible_severe_corruption" and got[6] == "near_exact" and got[7] == "other_variation"


def test_numbering_and_folds(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r["k"] == r["n"] for r in ordering.numbered(df, ["k"], "n").collect())
    sizes = ordering.folds(df.select(F.concat(F.lit("S1-"), "k").alias("entity_id"))).groupBy("fold").count().collect()
    assert {r["count"] for r in sizes} == {200}


def test_missing_keys_never_meet(spark):
    schema = ", ".join(f"{c} string" for c in tables.SOURCE_COLUMNS)
    a = spark.createDataFrame([("S1-1", None, None, "x"), ("S1-2", "!!", "??", "x"), ("S1-3", "a", None, "x")], schema)
    assert blocking.exact_candidates(blocking.normalize(a), blocking.normalize(a)).count() == 0
    assert audit.profile(a, "S1").first()["business_address_missing"] == 2


def test_extract_and_commands(spark, root, capsys):
    archive = root / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("d/x.tsv", "hello")
        z.writestr("d/.hidden", "no")
        z.writestr("__MACOSX/d/x.tsv", "no")
        z.writestr("other.txt", "no")
    assert main(["extract", "--archive", str(archive), "--target", str(root / "out"), "--prefix", "d/"]) == 0
    assert [p.name for p in (root / "out").rglob("*") if p.is_file()] == ["x.tsv"]
    with pytest.raises(FileExistsError):
        tables.extract(str(archive), str(root / "out"), "d/")
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("d/../../evil", "no")
    with pytest.raises(tables.SchemaError):
        tables.extract(str(archive), str(root / "out2"), "d/")
    truth = root / "t.tsv"
    put(truth, tables.TRUTH_COLUMNS, TRUTH)
    assert main(["evaluate", "--truth", str(truth), "--predictions", str(truth)]) == 0
    assert '"macro_f05": 1.0' in capsys.readouterr().out
    assert main(["validate", "-m", str(truth), "-t", str(root / "dataset/test")]) == 1
    said = capsys.readouterr().out.splitlines()
    assert said[-1] == "FAIL" and said[-2] == "5 rows, 2 empty, 3 non-empty"
