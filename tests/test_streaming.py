import pytest
from pyspark.sql import functions as F

import json
import random

from folio.sources import readers, writers
from folio.streaming import budget, jobs, limiter


def brute(calls, limit):
    taken, out = {}, {}
    for client, i, at in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        recent = [t for t in taken.get(client, []) if t > at - 60]
        out[i] = len(recent) < limit
        if out[i]:
            taken.setdefault(client, []).append(at)
    return out


def calls():
    rng = random.Random(5)
    return [(f"c{rng.choice([0, 0, 0, 1, 2])}", i, float(rng.randrange(400))) for i in range(400)]


def test_limiter_replay(spark):
    rows = calls()
    df = spark.createDataFrame([*rows, (None, 999, 1.0)], "client string, call_id bigint, at double")
    assert {r["call_id"]: r["allowed"] for r in limiter.replayed(df, 5).collect()} == brute(rows, 5)
    assert all(r["allowed"] for r in limiter.replayed(df, 0).collect())
    assert limiter.replayed(df.limit(0), 5).count() == 0


def test_limiter_stream(spark, tmp_path):
    rows = sorted(calls(), key=lambda c: (c[2], c[1]))
    for n in range(0, len(rows), 200):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{n:04}.json").write_text("".join(json.dumps(dict(zip(("client", "call_id", "at"), r, strict=True))) + "\n" for r in rows[n : n + 200]))
    stream = spark.readStream.schema("client string, call_id bigint, at double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = limiter.limited(stream, 5, evict=False).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r["call_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == brute(rows, 5)


EVENTS = [
    ("a", 1, 0.0, "created", None, None, None), ("a", 2, 1.0, "claim", None, None, None), ("a", 3, 2.0, "fail", 1, True, "busy"), ("a", 4, 2.5, "claim", None, None, None), ("a", 5, 9.0, "claim", None, None, None),
    ("a", 6, 10.0, "complete", 1, None, None), ("a", 7, 11.0, "complete", 2, None, None), ("b", 1, 0.0, "created", None, None, None), ("b", 2, 1.0, "claim", None, None, None), ("b", 3, 100.0, "reclaim", None, None, None),
    ("b", 4, 2000.0, "reclaim", None, None, None), ("b", 5, 2001.0, "claim", None, None, None), ("b", 6, 2002.0, "cancel", 2, None, None), ("b", 7, 2003.0, "claim", None, None, None), ("b", 8, 2004.0, "fail", 2, False, "bad"),
]
WANT = {("a", 1): ("applied", "pending"), ("a", 2): ("applied", "processing"), ("a", 3): ("applied", "pending"), ("a", 4): ("ignored", "pending"), ("a", 5): ("applied", "processing"), ("a", 6): ("stale", "processing"),
        ("a", 7): ("applied", "done"), ("b", 1): ("applied", "pending"), ("b", 2): ("applied", "processing"), ("b", 3): ("ignored", "processing"), ("b", 4): ("applied", "pending"), ("b", 5): ("applied", "processing"),
        ("b", 6): ("applied", "pending"), ("b", 7): ("applied", "processing"), ("b", 8): ("applied", "failed")}
SCHEMA = "job_id string, seq bigint, at double, event string, attempt int, retryable boolean, message string"


def test_jobs(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, SCHEMA)
    assert {(r["job_id"], r["seq"]): (r["outcome"], r["state"]) for r in jobs.replayed(df).collect()} == WANT
    df.repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = jobs.followed(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r["job_id"], r["seq"]): (r["outcome"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == WANT


def test_backoff(spark):
    df = spark.range(1, 9).selectExpr("cast(id AS int) AS n", "0.5D AS j", "cast(id * 200 AS double) AS r")
    got = df.select("n", "r", jobs.backoff_delay(df["n"], df["j"], df["r"]).alias("d")).collect()
    assert all(abs(x["d"] - jobs.backoff(x["n"], 0.5, x["r"])) < 1e-9 for x in got)


def test_readers(spark, tmp_path):
    folder = tmp_path / "labels"
    folder.mkdir()
    for i in (2, 1):
        (folder / f"{i}.json").write_text(json.dumps({"doc_id": f"d{i}", "fields": {"total": 0.1 + i, "line_items": []}, "evidence": {}}, indent=1))
    rows = readers.labels(spark, str(folder)).collect()
    assert [r["doc_id"] for r in rows] == ["d1", "d2"] and str(rows[0]["fields"]["total"]) == "1.100000"
    assert readers.labels(spark, str(folder), ["d2"], 1).first()["doc_id"] == "d2"
    (folder / "3.json").write_text("[1")
    try:
        readers.labels(spark, str(folder))
        raise AssertionError("a broken label was read")
    except readers.BadInput:
        pass
    path = tmp_path / "s.jsonl"
    path.write_text('{"name": "q", "start": 1.5, "ms": 3, "ok": true}\n{"name": "q", "sta')
    assert [r["ms"] for r in readers.samples(spark, str(path)).collect()] == [3.0]
    sizes = spark.createDataFrame([("1.5GiB",), ("20kB",), ("7B",), ("x",), (None,)], "t string")
    assert [r[0] for r in sizes.select(readers.byte_size(sizes["t"])).collect()] == [1.5 * 2**30, 20000.0, 7.0, None, None]
    lines = spark.createDataFrame([("1.5| extract |pending|3",), ("x|y|z|1",), ("1|2",)], "value string")
    assert [tuple(r) for r in readers.database_samples(lines).collect()] == [(1.5, "extract", "pending", 3)]


def test_writers(spark, tmp_path):
    base = str(tmp_path / "index")
    make = lambda rows: spark.createDataFrame(rows, "document_id string, n int, at int")
    shown = lambda: sorted((r["document_id"], r["n"]) for r in writers.current(spark, base).collect())
    assert writers.current(spark, base) is None
    writers.replace_documents(make([("a", 1, 0), ("a", 2, 0), ("b", 3, 0)]), base)
    writers.replace_documents(make([("a", 9, 0)]), base)
    assert shown() == [("a", 9), ("b", 3)]
    base = str(tmp_path / "reports")
    writers.upsert(make([("a", 1, 5), ("b", 2, 5)]), base, "document_id", "at")
    writers.upsert(make([("a", 7, 5), ("b", 8, 4)]), base, "document_id", "at")
    assert shown() == [("a", 7), ("b", 2)]
    assert [writers.write_once(spark, "{}", str(tmp_path), "run").rsplit("/", 1)[1] for _ in range(3)] == ["run.json", "run-2.json", "run-3.json"]
    assert writers.spliced("x<s>old<e>y", "new", "<s>", "<e>") == "x<s>\nnew\n<e>y"


def test_commits(spark, tmp_path):
    base = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "document_id string, n int")
    writers.replace_documents(make([(f"d{i}", i) for i in range(300)]), base)
    number, before = writers.head(spark, base)
    writers.replace_documents(make([("d7", 70)]), base)
    _, after = writers.head(spark, base)
    assert sum(before[b] != after[b] for b in before) == 1 and number == 1  # one bucket was rewritten
    assert writers.current(spark, base).agg({"n": "sum"}).first()[0] == sum(range(300)) + 63
    with pytest.raises(writers.ConflictingCommit):
        writers.commit(spark, base, number, before)
    gone = writers.vacuum(spark, base)
    assert gone == ["_commits/000000000001"] and writers.current(spark, base).count() == 300


def test_harvest(spark, tmp_path):
    labels = spark.createDataFrame([(1, "approved", 5), (2, "approved", None), (3, "corrected", -1)], "doc_id int, status string, total int")
    out = writers.harvest(labels, {"total": F.col("total").isNotNull(), "positive": F.col("total") > 0}, str(tmp_path / "h"))
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(2, ["positive", "total"]), (3, ["positive"])]
    assert [r["doc_id"] for r in spark.read.json(str(tmp_path / "h")).collect()] == [1]


@pytest.mark.parametrize("own,all_of", [(20, 60), (0, 60), (20, 0), (0, 0)])
def test_budget_gate(spark, own, all_of):
    import datetime as dt

    rng = random.Random(9)
    start = dt.datetime(2026, 1, 5, 22, 0)
    rows = [(i, rng.choice(["a", "a", "b", None]), start + dt.timedelta(seconds=rng.randrange(0, 15_000, 30)), None if rng.random() < 0.4 else rng.randrange(0, 300) / 100) for i in range(200)]
    rows.append((999, "a", None, None))
    got = {r["event_id"]: (r["refused_by"], r["retry_after"]) for r in budget.gated(spark.createDataFrame(rows, "event_id long, organization_id string, at timestamp_ntz, cost double"), own, all_of).collect()}
    want = {}
    for i, org, at, cost in rows:
        if cost is None and at is not None:
            before = [(o, c) for j, o, t, c in rows if c is not None and t.date() == at.date() and (t, j) < (at, i)]
            spent = sum(c for o, c in before if o == org)
            by = "organization" if org and own > 0 and round(spent, 6) >= own else "installation" if all_of > 0 and round(sum(c for _, c in before), 6) >= all_of else None
            left = 86_400 - (at - at.replace(hour=0, minute=0, second=0)).seconds
            want[i] = (by, left if by else None)
    assert got == want
