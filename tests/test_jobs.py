"""The four command-line workflows end to end on the given documents table."""

import json
import math
import os

import pytest

from conftest import SF001, SF01
from ticketspark import jobs
from ticketspark.sinks.manifest import read_published
from ticketspark.sources import fixtures as fx


def test_prepare_subset_evaluate_score(spark, tmp_dir):
    out = lambda *p: os.path.join(tmp_dir, *p)
    r = jobs.main(["prepare", "--input", f"{SF01}/documents.parquet", "--text-col", "text",
                   "--label-col", "lang", "--id-col", "doc_id", "--output", out("split")], spark)
    assert r["rows"] == 1000 and r["after_dedup"] == 927
    assert r["test"] == 140 and r["train"] == 787

    r = jobs.main(["subset", "--split", out("split"), "--per-class", "60", "--output", out("sub")], spark)
    assert r["rows"] == 60 * r["classes"]
    # capped: min(n, class size); train sizes de 99, en 489, es 86, fr 113 at sf0.01
    r = jobs.main(["subset", "--split", out("split"), "--per-class", "100", "--capped",
                   "--output", out("sub-capped")], spark)
    assert r["rows"] == 99 + 100 + 86 + 100

    r = jobs.main(["evaluate", "--split", out("split"), "--per-class", "10", "--model", "nb",
                   "--output", out("eval")], spark)
    assert r["n_samples"] == 40 and 0.0 <= r["accuracy"] <= 1.0
    assert os.path.isdir(out("eval", "metrics")) and os.path.isdir(out("eval", "predictions"))

    r = jobs.main(["evaluate", "--split", out("split"), "--per-class", "0", "--model", "keyword",
                   "--output", out("eval-kw")], spark)
    assert r["n_samples"] == 140

    r = jobs.main(["compare", "--baseline", out("eval-kw", "metrics"), "--tuned", out("eval", "metrics")], spark)
    assert set(r) == {"accuracy", "macro_f1", "weighted_f1", "unparseable_rate"}
    csv = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out("eval", "predictions"))
    assert {"source", "n_chars", "raw_output", "predicted_intent"} <= set(csv.columns)

    # raw request lines, without ids, by models from storage
    os.makedirs(out("lines"))
    with open(out("lines", "a.txt"), "w") as f:
        f.write('{"message": "the that and"}\n{"message": "der die und"}\n{bad\n{"message": "the that and"}\n')
    for model in ("nb", "lr"):
        jobs.main(["train", "--split", out("split"), "--model", model, "--output", out("m-" + model)], spark)
        r = jobs.main(["score", "--requests", out("lines"), "--format", "lines", "--model", model, "--model-path",
                       out("m-" + model), "--output", out("r-" + model), "--checkpoint", out("c-" + model)], spark)
        got = spark.read.parquet(out("r-" + model)).collect()
        assert r["batches"] == 1 and len({x.request_id for x in got}) == 4
        assert sum('"predicted_intent":"' in x.response for x in got) == 3
        if model == "nb":
            assert sum('"predicted_intent":"en"' in x.response for x in got) == 2
            assert sum('"predicted_intent":"de"' in x.response for x in got) == 1
        assert sum("malformed" in x.response for x in got) == 1

    reqs = fx.requests(spark, SF001).select("request_id", "body")
    reqs.write.json(out("requests"))
    r = jobs.main(["score", "--requests", out("requests"), "--labels", out("split"),
                   "--output", out("responses"), "--checkpoint", out("ck")], spark)
    assert spark.read.parquet(out("responses")).count() == reqs.count()
    r = jobs.main(["score", "--requests", out("requests"), "--labels", out("split"), "--append",
                   "--output", out("responses2"), "--checkpoint", out("ck2")], spark)
    assert r["responses"] == reqs.count()
    with pytest.raises(ValueError, match="row by row"):
        jobs.main(["score", "--requests", out("requests"), "--labels", out("split"), "--append", "--model", "nb",
                   "--output", out("responses3"), "--checkpoint", out("ck3")], spark)


def test_prepare_from_json_lines_without_id(spark, tmp_dir):
    """A1 from JSON lines, labels from the two-class binding, id derived when absent."""
    t2 = fx.tickets2(spark, SF01).select("instruction", "intent")
    src = os.path.join(tmp_dir, "tickets-json")
    t2.write.json(src)
    r = jobs.main(["prepare", "--input", src, "--format", "json", "--output",
                   os.path.join(tmp_dir, "split2")], spark)
    distinct = t2.select("instruction").distinct().count()
    assert r["rows"] == t2.count() and r["after_dedup"] == distinct
    assert r["test"] == math.ceil(distinct * 0.15)
    back = spark.read.parquet(os.path.join(tmp_dir, "split2"))
    assert back.select("ticket_id").distinct().count() == distinct


def test_rejected_rows_are_counted(spark, tmp_dir):
    t = fx.tickets(spark, SF01).where("ticket_id < 60").selectExpr(
        "ticket_id", "if(ticket_id % 10 = 0, null, instruction) instruction", "if(ticket_id % 7 = 0, null, intent) intent")
    t.write.parquet(os.path.join(tmp_dir, "in"))
    r = jobs.main(["prepare", "--input", os.path.join(tmp_dir, "in"), "--id-col", "ticket_id", "--output",
                   os.path.join(tmp_dir, "s"), "--rejects", os.path.join(tmp_dir, "bad")], spark)
    bad = spark.read.parquet(os.path.join(tmp_dir, "bad"))
    assert r["rows"] == t.count() and sum(r["rejected"].values()) == bad.count() > 0
    assert set(r["rejected"]) == {"null_text", "null_label"}


def test_derived_ids_do_not_depend_on_layout(spark, tmp_dir):
    t = fx.tickets2(spark, SF01).select("instruction", "intent")
    t.repartition(5).write.parquet(os.path.join(tmp_dir, "a"))
    t.coalesce(1).write.parquet(os.path.join(tmp_dir, "b"))
    a, b = (sorted(jobs.read_input(spark, os.path.join(tmp_dir, x), "parquet", "instruction", "intent", None)
                   .select("ticket_id", "intent").collect()) for x in "ab")
    assert a == b and len({r.ticket_id for r in a}) == len(a)


def test_json_lines_keep_all_columns(spark, tmp_dir):
    src = os.path.join(tmp_dir, "more-json")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('{"instruction": "hi there", "intent": "a", "category": "x", "extra": {"k": [1]}}\n' * 2)
        f.write('{"instruction": "bye now", "intent": "b", "late": 7}\nnot json\n')
    got = jobs.read_input(spark, src, "json", "instruction", "intent", None)
    rows = {r.instruction: r for r in got.collect()}
    assert set(got.columns) == {"instruction", "intent", "category", "extra", "late", "ticket_id", "raw_record"}
    assert rows[None].raw_record == "not json"
    assert (rows["hi there"].category, rows["hi there"].extra, rows["bye now"].late) == ("x", '{"k": [1]}', "7")


def test_equal_rows_in_many_tasks_get_the_ids_of_one_task(spark, tmp_dir):
    rows = spark.createDataFrame([("same", "a")] * 500 + [("other", "b")], "instruction string, intent string")
    ids = []
    for n in (1, 7):
        rows.repartition(n).write.parquet(os.path.join(tmp_dir, f"p{n}"))
        df = jobs.read_input(spark, os.path.join(tmp_dir, f"p{n}"), "parquet", "instruction", "intent", None)
        ids.append(sorted(r.ticket_id for r in df.collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 501


def test_broken_records_are_rejected_as_they_stand(spark, tmp_dir):
    """A1: every record is valid or rejected, and a broken one is found there unchanged."""
    good = [{"instruction": f"hello number {i}", "intent": "ab"[i % 2], "n": i} for i in range(40)]
    lines = [json.dumps(x) for x in good] + ['{"instruction": "cut off', 'not json "at" all', '{"intent": "a"}', '{"instruction": "no label"}']
    src = os.path.join(tmp_dir, "in-json")
    os.makedirs(src)
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write("\n".join(lines) + "\n")
    for k, extra in enumerate(([], ["--schema", "instruction string, intent string, n int"])):
        r = jobs.main(["prepare", "--input", src, "--format", "json", "--output", os.path.join(tmp_dir, f"s{k}"),
                       "--rejects", os.path.join(tmp_dir, f"bad{k}"), *extra], spark)
        assert r["rejected"] == {"malformed": 2, "null_text": 1, "null_label": 1}
        assert r["rows"] == r["train"] + r["test"] + 4 == len(lines)
        bad = spark.read.parquet(os.path.join(tmp_dir, f"bad{k}"))
        assert {x.raw_record for x in bad.collect()} == {lines[40], lines[41], None}
        assert "raw_record" not in read_published(spark, os.path.join(tmp_dir, f"s{k}")).columns

    csv = os.path.join(tmp_dir, "in-csv")
    os.makedirs(csv)
    rows = ["instruction,intent,n", '"two\nlines, and ""quotes""",a,1', "x,b,2", "y,a,3", "z,b,4", "too,many,fields,here", "w,a,no number"]
    with open(os.path.join(csv, "a.csv"), "w") as f:
        f.write("\n".join(rows) + "\n")
    r = jobs.main(["prepare", "--input", csv, "--format", "csv", "--output", os.path.join(tmp_dir, "s-csv"), "--rejects",
                   os.path.join(tmp_dir, "bad-csv"), "--schema", "instruction string, intent string, n int"], spark)
    assert r["rejected"] == {"malformed": 2} and r["rows"] == 6
    bad = spark.read.parquet(os.path.join(tmp_dir, "bad-csv")).collect()
    assert {x.raw_record for x in bad} == {"too,many,fields,here", "w,a,no number"}
    back = read_published(spark, os.path.join(tmp_dir, "s-csv"))
    assert 'two\nlines, and "quotes"' in {x.instruction for x in back.collect()}


def test_a_failed_run_leaves_the_split_before(spark, tmp_dir):
    t = fx.tickets2(spark, SF01).select("instruction", "intent")
    t.write.parquet(os.path.join(tmp_dir, "in"))
    out = os.path.join(tmp_dir, "split")
    args = ["prepare", "--input", os.path.join(tmp_dir, "in"), "--output", out]
    first = jobs.main(args, spark)
    with pytest.raises(Exception):
        jobs.main([*args[:1], "--input", os.path.join(tmp_dir, "nowhere"), *args[3:]], spark)
    assert read_published(spark, out).count() == first["train"] + first["test"]
    again = jobs.main([*args, "--seed", "7"], spark)
    assert (again["train"], again["test"]) == (first["train"], first["test"])
    assert spark.read.parquet(out).count() == again["train"] + again["test"]  # the older version is gone
