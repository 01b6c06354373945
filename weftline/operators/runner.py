"""Runs scripts of SQL statements, one after another, each script in a session of its own."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from weftline.operators.sqllineage import statements

OUTCOME = "script string, place int, statement string, state string, error string"


def run(spark: SparkSession, script: str, settings: dict[str, str] | None = None) -> tuple[list[tuple[int, str, str, str | None]], DataFrame | None]:
    """((place from 1, statement, state, error) of each statement, result of the last that ran).

    Semicolons within quotes and comments part nothing. States are OK, FAILED for the first one that fails, at which the script stops, and NOT_RUN for those after it.
    ``settings`` and SET statements hold for the script's own session, and so do its temporary views; the caller's session stays as it is. Commands and
    the queries of results are both executed, as a runner that prints nothing would.
    """
    session, out, last, failed = spark.newSession(), [], None, False
    for key, value in (settings or {}).items():
        session.conf.set(key, value)
    for place, text in enumerate(statements(script), 1):
        if failed:
            out.append((place, text, "NOT_RUN", None))
            continue
        try:
            last = session.sql(text)
            last.write.format("noop").mode("overwrite").save() if last.columns else None
            out.append((place, text, "OK", None))
        except PySparkException as e:
            failed = True
            out.append((place, text, "FAILED", e.getCondition() or type(e).__name__))
    return out, last


def exit_code(outcomes: list[tuple[int, str, str, str | None]]) -> int:
    """0 if all statements ran or there were none, else 3."""
    return 3 if any(state == "FAILED" for _, _, state, _ in outcomes) else 0


def run_all(spark: SparkSession, scripts: DataFrame, key: str = "script", text: str = "text") -> DataFrame:
    """Outcomes of a table of scripts, one script at a time in the order of their keys; scripts come to the driver one by one, as what they hold is run from there."""
    rows = []
    for r in scripts.select(key, text).where(f"{text} is not null").orderBy(key).toLocalIterator():
        rows += [(str(r[0]), *x) for x in run(spark, r[1])[0]]
    return spark.createDataFrame(rows, OUTCOME)
