"""Verdicts of training runs as their metrics come in, with a small state for each run.

A run's state holds its last ``LATE`` complete steps, steps that are not complete yet, and of all
before only what a verdict needs: how many, the first point, the last validation losses, and whether
any value was no finite number. So a batch costs what came in, and a run of any length the same.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loamline.operators.curves import DROP, EXPLODED, GRAD, LAST, RISE, TRAIN, VALID
from loamline.sources import versions
from loamline.streaming.logs import metric_stream

#: Complete steps that may still get values; what comes for earlier ones is counted as late.
LATE = 64
VERDICTS = "run string, n long, verdict string, message string, tardifs long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh() -> dict:
    return {"open": {}, "recent": {}, "n": 0, "odd": False, "first": None, "valid": [], "until": None, "late": 0}


def _odd(step: dict) -> bool:
    return any(name in step and not math.isfinite(step[name][1]) for name in (TRAIN, VALID, GRAD))


def told(state: dict, etape: int, name: str, value: float, stamp: float) -> None:
    """One value; of several of a name and step the last by time counts (of equal times the one that came last)."""
    if state["until"] is not None and etape <= state["until"]:
        state["late"] += 1
        return
    at = str(etape)
    step = state["recent"].get(at) or state["open"].setdefault(at, {})
    if name not in step or stamp >= step[name][0]:
        step[name] = [stamp, value]
    if at in state["open"] and TRAIN in step and GRAD in step:
        state["recent"][at] = state["open"].pop(at)
    while len(state["recent"]) > LATE:
        _retire(state, min(state["recent"], key=int))


def _retire(state: dict, at: str) -> None:
    """A step that gets no values any more, as part of the summary; steps before it that never were complete go."""
    step = state["recent"].pop(at)
    state["n"] += 1
    state["odd"] = state["odd"] or _odd(step)
    state["first"] = state["first"] or [step[TRAIN][1], step[GRAD][1]]
    if VALID in step:
        state["valid"] = [*state["valid"], step[VALID][1]][-LAST:]
    state["until"] = int(at)
    state["open"] = {k: v for k, v in state["open"].items() if int(k) > state["until"]}


def verdict(state: dict) -> tuple[int, str | None, str, int]:
    """n, verdict, message and late values, as ``curves.live_verdicts`` has them for the whole log."""
    steps = [state["recent"][k] for k in sorted(state["recent"], key=int)]
    n = state["n"] + len(steps)
    valid = [*state["valid"], *(s[VALID][1] for s in steps if VALID in s)]
    message = "pas assez de points complets" if n < 2 else "" if valid else "sans perte de validation"
    if n < 2:
        return n, None, message, state["late"]
    t0, g0 = state["first"] or [steps[0][TRAIN][1], steps[0][GRAD][1]]
    t1, g1 = steps[-1][TRAIN][1], steps[-1][GRAD][1]
    rise = valid[-LAST:][-1] - valid[-LAST:][0] if len(valid) >= 2 else None
    if state["odd"] or any(map(_odd, steps)) or (g0 > 0 and g1 / g0 >= EXPLODED and t1 > t0):
        found = "instable"
    elif (0.0 if t0 == 0 else (t0 - t1) / t0) < DROP:
        found = "sous_apprentissage"
    else:
        found = "surapprentissage" if rise is not None and rise > RISE else "saine"
    return n, found, message, state["late"]


class RunWatch(StatefulProcessor):
    """One value of state a run: its summary as JSON."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "summary string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else fresh()
        for some in rows:
            for etape, name, value, stamp in zip(some["etape"], some["nom"], some["valeur"], some["horodatage"], strict=True):
                if name in (TRAIN, VALID, GRAD) and not pd.isna(etape) and value is not None:
                    told(state, int(etape), name, float(value), float(stamp))
        self.state.update((json.dumps(state),))
        n, found, message, late = verdict(state)
        yield pd.DataFrame({"run": [key[0]], "n": [n], "verdict": [found], "message": [message], "tardifs": [late]})

    def close(self) -> None:
        pass


def run_verdicts(stream: DataFrame) -> DataFrame:
    """Verdicts of the runs that got values (run, etape, nom, valeur, horodatage), as they change. The session's state store has to be RocksDB (``with_state_store``)."""
    rows = stream.select("run", "etape", "nom", "valeur", "horodatage").filter("valeur is not null")
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=RunWatch(), outputStructType=VERDICTS, outputMode="Update", timeMode="None")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def watch_runs(spark: SparkSession, folder: str, path: str, checkpoint: str, *, buckets: int = 16) -> StreamingQuery:
    """Keeps a table of verdicts (``versions``, by run) over a folder of metric files, over what there is; each batch rewrites the buckets of its runs only, and counts once."""
    with_state_store(spark)

    def merged(batch: DataFrame, number: int) -> None:
        versions.upsert(batch, path, key="run", order="n", buckets=buckets, writer=checkpoint, batch=number)

    out = run_verdicts(metric_stream(spark, folder)).writeStream.outputMode("update").foreachBatch(merged)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
