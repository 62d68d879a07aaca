"""Several writers, landing files exactly once, digests of past rows, gates that add up."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from netsluice import schema
from netsluice.operators.detections import clear_log, log_detections, read_detections
from netsluice.operators.digest_store import DigestStore
from netsluice.plans import landing
from netsluice.plans.pipeline import file_verdicts
from netsluice.plans.registry import log_run, training_runs
from netsluice.quality import ledger
from netsluice.sources import generations


def values(df):
    return sorted(r[0] for r in df.collect())


def test_generations(spark, tmp_path):
    root = str(tmp_path / "log")
    assert generations.generation(spark, root) == 0 and generations.read(spark, root, "id long").count() == 0
    for k in range(3):
        assert generations.append(spark.range(k, k + 1), root, {"k": k}) == k + 1
    assert values(generations.read(spark, root, "id long")) == [0, 1, 2]
    assert values(generations.read(spark, root, "id long", upto=2)) == [0, 1]
    assert values(generations.read(spark, root, "id long", which=lambda c: c.note["k"] == 1)) == [1]
    assert generations.commit(spark, root, clears=True) == 4 and generations.read(spark, root, "id long").count() == 0
    assert generations.replace(spark.range(7, 8), root) == 5 and values(generations.read(spark, root, "id long")) == [7]
    assert values(generations.read(spark, root, "id long", upto=3)) == [0, 1, 2]
    with pytest.raises(generations.Conflict):
        generations.commit(spark, root, after=3)
    assert generations.commit(spark, root, after=5) == 6
    assert not [f for f in os.listdir(f"{root}/commits") if not f.endswith(".json") and not f.endswith(".crc")]


def test_writers_at_once_lose_nothing(spark, tmp_path):
    root = str(tmp_path / "detections")
    log_detections(spark.range(1000, 1005), root)
    clear_log(spark, root)
    errors = []

    def write(k):
        try:
            for i in range(3):
                log_detections(spark.range(10 * k + i, 10 * k + i + 1), root)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert values(read_detections(spark, root, "id long")) == sorted(10 * k + i for k in range(6) for i in range(3))
    assert generations.generation(spark, root) == 20


def test_training_runs(spark, tmp_path):
    assert training_runs(spark, str(tmp_path)).count() == 0
    for k in range(2):
        log_run(spark, str(tmp_path), f"run{k}", {"a": k}, {"m": 0.5}, None)
    assert sorted(r.run_id for r in training_runs(spark, str(tmp_path)).collect()) == ["run0", "run1"]


@pytest.fixture
def folder(tmp_path, flows):
    """A landing folder, and a function that writes a file of so many flows into it."""
    path = tmp_path / "landing"
    path.mkdir()

    def put(name, rows, first=0, at=1_700_000_000, **replaced):
        df = flows(rows, **{"Flow Duration": lambda i: float(first + i)}, **replaced)
        lines = [",".join(schema.RAW_FIELDS)] + [",".join("" if v is None else str(v) for v in r) for r in df.collect()]
        (path / name).write_text("\n".join(lines) + "\n", encoding="latin-1")
        os.utime(path / name, (at, at))

    return str(path), put


def durations(df):
    return sorted(int(r[0]) for r in df.select("Flow Duration").collect())


def run(spark, folder, root, **more):
    return landing.ingest_landing(spark, folder, root, min_bytes=10, **more)


def test_every_file_once(spark, folder, tmp_path):
    path, put = folder
    root = str(tmp_path / "raw")
    with pytest.raises(LookupError):
        landing.ingested(spark, root)
    put("a.csv", 3)
    put("b.csv", 2, first=10)
    (tmp_path / "landing" / "c.csv").write_text("<html>" + "x" * 100)
    assert run(spark, path, root) == {"generation": 1, "files": 2, "rows": 5}
    assert run(spark, path, root) == {"generation": 1, "files": 0, "rows": 0}

    def fails(rows):
        assert rows.count() == 4
        raise RuntimeError("gate")

    put("d.csv", 4, first=20)
    with pytest.raises(RuntimeError):
        run(spark, path, root, check=fails)
    assert generations.generation(spark, root) == 1 and len(durations(landing.ingested(spark, root))) == 5
    assert run(spark, path, root)["rows"] == 4
    # a file that changes is taken again, its old rows go; one that leaves keeps its rows
    put("a.csv", 1, first=30, at=1_700_000_100)
    os.remove(os.path.join(path, "b.csv"))
    assert run(spark, path, root)["files"] == 1
    assert durations(landing.ingested(spark, root)) == [10, 11, 20, 21, 22, 23, 30]
    assert durations(landing.ingested(spark, root, upto=1)) == [0, 1, 2, 10, 11]
    state = {r.name: (r.present, r.admitted, r.reason) for r in landing.landing_state(spark, root).collect()}
    assert state == {"a.csv": (True, True, None), "b.csv": (False, True, None), "c.csv": (True, False, "html page"), "d.csv": (True, True, None)}
    assert run(spark, path, root)["files"] == 0


def test_two_runs_at_once(spark, folder, tmp_path, monkeypatch):
    path, put = folder
    root = str(tmp_path / "raw")
    put("a.csv", 3)
    real, raced = landing.landing_changes, []

    def other_run_first(now, last):
        if not raced:
            raced.append(True)
            assert run(spark, path, root)["files"] == 1
        return real(now, last)

    monkeypatch.setattr(landing, "landing_changes", other_run_first)
    assert run(spark, path, root) == {"generation": 1, "files": 0, "rows": 0}
    assert durations(landing.ingested(spark, root)) == [0, 1, 2]


def test_digest_store(spark, tmp_path):
    store = DigestStore(spark, str(tmp_path / "digests"), buckets=4).open()
    rows = lambda *v: spark.createDataFrame([(x, str(x)) for x in v], "a long, b string")
    assert store.add(rows(1, 1, 2, 3), "one") == {"rows": 4, "repeats": 1, "seen_before": 0}
    assert store.add(rows(3, 3, 4), "two") == {"rows": 3, "repeats": 1, "seen_before": 2}
    assert store.add(rows(3, 3, 4), "two") == {"rows": 3, "repeats": 1, "seen_before": 2}
    assert store.add(rows(1, 1, 2, 3), "one") == {"rows": 4, "repeats": 1, "seen_before": 0}
    assert store.rows().count() == 4
    assert store.add(rows().limit(0), "none") == {"rows": 0, "repeats": 0, "seen_before": 0}
    spark.sql(f"drop table {store.table}")  # another session: the folder alone is enough
    again = DigestStore(spark, str(tmp_path / "digests"), buckets=4).open()
    assert again.add(rows(2, 4, 9), "three") == {"rows": 3, "repeats": 0, "seen_before": 2}


def test_old_digests_are_not_moved(spark, tmp_path):
    store = DigestStore(spark, str(tmp_path / "digests"), buckets=4).open()
    store.add(spark.range(100), "one")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = store.met(store.digests(spark.range(50, 150)), "two")
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert met.where("seen").count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    lines = plan.splitlines()
    [scan] = [k for k, line in enumerate(lines) if "FileScan" in line]
    assert "Bucketed: true" in lines[scan]
    # from the store's scan up to the sort under its join
    sort = max(k for k in range(scan) if "Sort [" in lines[k])
    assert not any("Exchange" in x for x in lines[sort:scan]) and "Exchange" in plan


def verdicts(df, key):
    return {(r[key], r.rule_name): (r.passed, r.severity, r.message, tuple(sorted(r.details.items()))) for r in df.collect()}


def test_ledger_equals_the_whole_gate(spark, folder, tmp_path, monkeypatch):
    path, put = folder
    root = str(tmp_path / "ledger")
    put("a.csv", 30)
    put("b.csv", 20, **{"Destination Port": 99999})
    with pytest.raises(LookupError):
        ledger.ledger_verdicts(spark, path, root).collect()
    assert ledger.update_ledger(spark, path, root) == 2 and ledger.update_ledger(spark, path, root) == 0
    put("c.csv", 10, first=50, **{"Label": lambda i: None if i < 4 else "BENIGN"})
    read = []
    real = ledger.read_raw_flows
    monkeypatch.setattr(ledger, "read_raw_flows", lambda s, names, **k: read.extend(names) or real(s, names, **k))
    assert ledger.update_ledger(spark, path, root) == 1
    assert [n.rsplit("/", 1)[1] for n in read] == ["c.csv"]
    norm = F.regexp_replace("source", "^file:/+", "file:///")
    whole = file_verdicts(spark, path).withColumn("source", norm)
    assert verdicts(ledger.ledger_verdicts(spark, path, root), "source") == verdicts(whole, "source")
    # sums over files: a folder of files without repeats between them is judged as one table
    together = verdicts(file_verdicts(spark, path, by_folder=True).withColumn("source", norm), "source")
    assert verdicts(ledger.ledger_verdicts(spark, path, root, "folder"), "source") != {}
    shown = {k: v for k, v in verdicts(ledger.ledger_verdicts(spark, path, root, "folder"), "source").items() if k[1] != "duplicate_row_rate"}
    assert shown == {k: v for k, v in together.items() if k[1] != "duplicate_row_rate"}
    assert {r.passed for r in ledger.ledger_verdicts(spark, path, root, "all").where("rule_name = 'port_range_valid'").collect()} == {False}
    # a file that changes is measured again, one that leaves no longer counts
    put("b.csv", 20, at=1_700_000_500)
    assert ledger.update_ledger(spark, path, root) == 1
    os.remove(os.path.join(path, "c.csv"))
    by_day = ledger.ledger_verdicts(spark, path, root, "day")
    assert {r.passed for r in by_day.where("rule_name in ('port_range_valid', 'label_null_rate')").collect()} == {True}


def test_measuring_hashes_one_text_a_row_and_plans_names_once(spark, monkeypatch):
    """Rows of texts are told apart by one JSON array: nulls, empty texts, moved borders and bytes that are no text."""
    from netsluice.functions.keys import text_digest, texts_json
    from netsluice.quality import rules

    rows = [("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("null", "abc"), ('a","b', None), ("a", 'b",null'), ("a", "bc")]
    df = spark.createDataFrame(rows, "x string, y string")
    bad = spark.sql("select cast(x'FF' as string) as x, 'z' as y union all select cast(x'FE' as string), 'z' union all select '\ufffd', 'z'")
    both = df.unionByName(bad).withColumn("_json", texts_json(["x", "y"]))
    digests = [bytes(r.d) for r in both.select(text_digest(both, ["x", "y"], "_json").alias("d")).collect()]
    assert len(set(digests)) == 10 and digests[0] == digests[7] and {len(d) for d in digests} == {32}

    template = ledger._template(spark)
    names = rules.raw_measures(template).columns
    monkeypatch.setattr(rules, "raw_measures", None)
    monkeypatch.setattr(ledger, "raw_measures", None)  # the names come from the rules, no aggregate is planned for them
    assert ledger._measures(spark) == names
