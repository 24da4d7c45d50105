"""Tables in versions: kills between write and publication, two writers, readers in between; verdicts from small states."""

import json
import math
import random

import pytest


from loamline.functions import clock
from loamline.operators import curves, inference
from loamline.sources import versions
from loamline.streaming import logs, runs

ROWS = "identifiant string, v int, o int"


def rows(spark, pairs):
    return spark.createDataFrame([(k, v, v) for k, v in pairs], ROWS)


def content(spark, path, version=None):
    return sorted((r.identifiant, r.v) for r in versions.read(spark, path, ROWS, version).collect())


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.upsert(rows(spark, [(f"k{i}", i) for i in range(200)]), path, order="o", buckets=8)
    before = versions.current(spark, path)
    versions.upsert(rows(spark, [("k7", 1000), ("k7", 999)]), path, order="o")
    after = versions.current(spark, path)
    assert sum(before.data[b] != after.data[b] for b in before.data) == 1
    assert content(spark, path) == sorted([(f"k{i}", i) for i in range(200) if i != 7] + [("k7", 1000)])
    # a reader of the version before sees it whole
    assert content(spark, path, before) == sorted((f"k{i}", i) for i in range(200))
    assert versions.sharing(rows(spark, [("k7", 0)]), path, ROWS).filter("identifiant = 'k7'").first().v == 1000
    assert versions.sharing(rows(spark, [("k7", 0)]), path, ROWS).count() < 100


def test_two_writers(spark, tmp_path):
    path = f"{tmp_path}/t"
    versions.upsert(rows(spark, [("a", 1)]), path, order="o")
    both = versions.current(spark, path)
    versions.upsert(rows(spark, [("a", 2)]), path, order="o", since=both)
    with pytest.raises(versions.Conflict):
        versions.upsert(rows(spark, [("a", 3), ("b", 3)]), path, order="o", since=both)
    assert content(spark, path) == [("a", 2)]
    versions.upsert(rows(spark, [("b", 3)]), path, order="o")
    assert content(spark, path) == [("a", 2), ("b", 3)]


def test_kill_before_publication(spark, tmp_path, monkeypatch):
    path, publish = f"{tmp_path}/t", versions.publish
    versions.append(rows(spark, [("a", 1)]), path, writer="w", batch=0)

    def killed(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(versions, "publish", killed)
    with pytest.raises(RuntimeError, match="killed"):
        versions.append(rows(spark, [("b", 1)]), path, writer="w", batch=1)
    assert content(spark, path) == [("a", 1)]
    monkeypatch.setattr(versions, "publish", publish)
    assert versions.append(rows(spark, [("b", 1)]), path, writer="w", batch=1)
    assert not versions.append(rows(spark, [("b", 1)]), path, writer="w", batch=1)
    assert not versions.append(rows(spark, [("c", 1)]), path, writer="w", batch=0)
    assert versions.append(rows(spark, [("d", 1)]), path, writer="other", batch=0)
    assert content(spark, path) == [("a", 1), ("b", 1), ("d", 1)]
    assert versions.vacuum(spark, path, keep=1) == 1  # what the killed one had written
    versions.compact(spark, path, ROWS)
    assert content(spark, path) == [("a", 1), ("b", 1), ("d", 1)]
    assert versions.vacuum(spark, path, keep=1) == 3
    assert content(spark, path) == [("a", 1), ("b", 1), ("d", 1)]
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path, 0)


def test_appends_that_race_all_count(spark, tmp_path, monkeypatch):
    path, publish, raced = f"{tmp_path}/t", versions.publish, []

    def late(spark, path, version):
        if not raced:
            raced.append(1)
            versions.append(rows(spark, [("first", 1)]), path)
        publish(spark, path, version)

    monkeypatch.setattr(versions, "publish", late)
    versions.append(rows(spark, [("second", 1)]), path, writer="w", batch=0)
    assert content(spark, path) == [("first", 1), ("second", 1)]


def test_missing_and_keyed_tables(spark, tmp_path):
    assert content(spark, f"{tmp_path}/none") == []
    assert versions.sharing(rows(spark, [("a", 1)]), f"{tmp_path}/none", ROWS).count() == 0
    versions.upsert(rows(spark, []), f"{tmp_path}/t", order="o")
    versions.upsert(rows(spark, [("a", 1), (None, 2)]), f"{tmp_path}/t", order="o")
    assert versions.read(spark, f"{tmp_path}/t", ROWS).count() == 2
    with pytest.raises(ValueError, match="keyed"):
        versions.append(rows(spark, [("a", 1)]), f"{tmp_path}/t")
    with pytest.raises(ValueError, match="keyed"):
        versions.upsert(rows(spark, [("a", 1)]), f"{tmp_path}/t", key="v", order="o")


def test_settled_waves_count_once(spark, tmp_path):
    answers = spark.createDataFrame([("a", [("user", "q")], "r", 1.0, 1, None, None)], "identifiant string, messages array<struct<role:string,contenu:string>>, texte string, latence_ms double, nombre_tokens_sortie int, type_erreur string, erreur string")
    for wave in ("w1", "w1", "w2"):
        inference.settled(answers, f"{tmp_path}/log", "tour", "m", clock.fixed("t0"), wave=wave)
    assert inference.logged(spark, f"{tmp_path}/log").count() == 2


def test_resume_once(spark, tmp_path, monkeypatch):
    source, publish, kills = tmp_path / "in", versions.publish, [1]
    source.mkdir()

    def once_killed(*args):
        if kills:
            kills.pop()
            raise RuntimeError("killed")
        publish(*args)

    def start(checkpoint):
        stream = spark.readStream.schema("identifiant string").json(str(source))
        logs.resume_once(stream, f"{tmp_path}/out", "identifiant string", lambda d: d, f"{tmp_path}/{checkpoint}", buckets=4).awaitTermination()

    def there():
        return sorted(r.identifiant for r in versions.read(spark, f"{tmp_path}/out", "identifiant string").collect())

    (source / "a.json").write_text('{"identifiant": "a"}\n{"identifiant": "b"}\n{"identifiant": "a"}\n')
    monkeypatch.setattr(versions, "publish", once_killed)
    with pytest.raises(Exception, match="killed"):
        start("cp")
    assert there() == []
    start("cp")
    assert there() == ["a", "b"]
    (source / "b.json").write_text('{"identifiant": "b"}\n{"identifiant": "c"}\n')
    start("cp")
    start("another")
    assert there() == ["a", "b", "c"]


NAMES = [curves.TRAIN, curves.VALID, curves.GRAD]


def history(rng, run, n):
    """Metric rows of a run, of which some are told twice, some steps stay open and validation comes late."""
    out, train = [], rng.choice([2.0, 0.0])
    for s in range(n):
        train += rng.choice([-0.1, -0.02, 0.05])
        out.append((run, s, curves.TRAIN, train, float(s)))
        if rng.random() < 0.9:
            out.append((run, s, curves.GRAD, rng.choice([0.0, 1.0, 1.2, 30.0]) if rng.random() < 0.3 else 1.0, float(s)))
        if rng.random() < 0.4:
            out.append((run, s, curves.VALID, rng.choice([1.0, 1.1, 0.9, math.inf if rng.random() < 0.02 else 1.02]), s + 0.5))
        if rng.random() < 0.1:
            out.append((run, s, curves.TRAIN, train - 0.01, s + 0.7))
        if s > 5 and rng.random() < 0.1:
            out.append((run, s - 3, curves.VALID, 1.3, float(s)))
    return out


def test_states_agree_with_the_whole_log(spark):
    rng = random.Random(5)
    every = [r for k in range(40) for r in history(rng, f"r{k}", rng.choice([0, 1, 2, 3, 10, 63, 64, 65, 150, 400]))]
    df = spark.createDataFrame(every, "run string, etape int, nom string, valeur double, ord double")
    want = {r.run: (r.verdict, r.message) for r in curves.live_verdicts(curves.wide(df, NAMES)).collect()}
    states = {}
    for run, etape, name, value, stamp in every:
        state = states.setdefault(run, runs.fresh())
        runs.told(state, etape, name, value, stamp)
        states[run] = json.loads(json.dumps(state))
        assert len(state["recent"]) <= runs.LATE and len(state["open"]) <= 2 * runs.LATE
    assert {k: runs.verdict(s)[1:3] for k, s in states.items()} == want
    assert len(set(want.values())) >= 4


def test_watch_runs(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = random.Random(6)
    every = [r for k in range(6) for r in history(rng, f"r{k}", 100)]
    every.sort(key=lambda r: r[4])

    def write(name, part):
        (folder / name).write_text("".join(json.dumps({"run": r, "etape": s, "nom": n, "valeur": "Infinity" if v == math.inf else v, "horodatage": h}) + "\n" for r, s, n, v, h in part))

    def start():
        runs.watch_runs(spark, str(folder), f"{tmp_path}/out", f"{tmp_path}/cp", buckets=4).awaitTermination()
        return {r.run: (r.verdict, r.message) for r in versions.read(spark, f"{tmp_path}/out", runs.VERDICTS).collect()}

    def whole():
        return {r.run: (r.verdict, r.message) for r in curves.live_verdicts(curves.wide(spark.createDataFrame(seen, "run string, etape int, nom string, valeur double, ord double"), NAMES)).collect()}

    cut = len(every) // 2
    seen = every[:cut]
    write("a.json", seen)
    assert start() == whole()
    seen = every
    write("b.json", every[cut:])
    assert start() == whole()
    assert start() == whole()
    write("c.json", [("r0", 1000, curves.TRAIN, 9.0, 1000.0)])  # a last step that is not whole
    assert start() == whole()
