"""Where delivered rows go: callbacks, JSON lines, counters, logs of figures."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one folder for all tasks; bytes are written in base64."""
    rows.write.mode(mode).json(path)


def pretty_json(rows: DataFrame) -> Iterator[str]:
    """Every row as an indented JSON text, one partition after the other, so the caller holds no more than one."""
    for text in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield json.dumps(json.loads(text["j"]), indent=2, ensure_ascii=False)


def for_each(rows: DataFrame, callback: Callable[[Row], None]) -> None:
    """Calls back for every row, on the executors. A task that is run again calls back again."""

    def part(it: Iterator[Row]) -> None:
        for r in it:
            callback(r)

    rows.foreachPartition(part)


def for_each_batch(rows: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls back with the rows of every micro-batch of a stream."""
    return rows.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).start()


def exposition(counts: DataFrame, name: str, labels: list[str], value: str = "n") -> Iterator[str]:
    """Counters by label in the text format that metric collectors read, line by line, in the order of their labels.

    Lines are made by the executors; the caller takes one partition after the other, however many label sets there are.
    """
    quoted = [F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(k).cast("string"), F.lit("None")), "\\\\", "\\\\\\\\"), '"', '\\\\"'), "\n", "\\\\n") for k in labels]
    parts = [F.concat(F.lit(f'{k}="'), q, F.lit('"')) for k, q in zip(labels, quoted, strict=True)]
    line = F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string"))
    yield f"# TYPE {name} counter"
    for r in counts.select(line.alias("line")).orderBy("line").toLocalIterator():
        yield r["line"]


def run_for(query: StreamingQuery, seconds: float | None) -> bool:
    """Waits until a stream has run as long as its configuration says, then stops it; without a time until it ends by
    itself. Whether it was stopped."""
    if query.awaitTermination(seconds):
        return False
    query.stop()
    return True


def write_log(figures: DataFrame, path: str, form: str = "csv") -> None:
    """Figures of a run as one CSV file with a header, or as JSON lines."""
    if form not in ("csv", "json"):
        raise ValueError(form)
    w = figures.coalesce(1).write.mode("append")
    (w.option("header", True).csv if form == "csv" else w.json)(path)
