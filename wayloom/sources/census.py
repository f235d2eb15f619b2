"""Tables of census figures exported as one CSV and one JSON description a folder."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _labels(columns: dict) -> dict[str, str]:
    """Column codes to names that carry the headings they stand under."""
    out, above = {}, {}
    for code, column in columns.items():
        level = column["indent"]
        above[level] = column["name"].replace(":", "_").strip("_")
        path = "_".join(above[k] for k in range(1, level) if k in above)
        out[code] = f"{path}_{column['name']}".strip("_")
    return out


def _folder(spark: SparkSession, folder: str, level: int | str | None, drop_errors: bool, suffix: Sequence[str]) -> DataFrame | None:
    names = sorted(os.listdir(folder))
    tables, notes = [n for n in names if n.endswith(".csv")], [n for n in names if n.endswith(".json")]
    if not tables or not notes:
        return None
    with open(os.path.join(folder, notes[0])) as f:
        note = json.load(f)
    code, table = next(iter(note["tables"].items()))
    facts = {**{k: note["release"][k] for k in ("id", "years", "name")}, **{k: table.get(k) for k in ("title", "denominator_column_id", "universe")}, "table": code}
    df = spark.read.csv(os.path.join(folder, tables[0]), header=True, inferSchema=True).withColumn("geoid", F.col("geoid").cast("string"))
    if level == "auto":
        usual = df.where("geoid is not null").groupBy(F.length("geoid").alias("n")).count().orderBy(F.desc("count"), "n").first()
        df = df.where(F.length("geoid") == usual.n) if usual else df
    elif level is not None:
        df = df.where(F.length("geoid") == int(level))
    tail = "_".join(str(facts[s]) for s in suffix)
    renamed = {c: n + (f"_{tail}" if tail else "") for c, n in _labels(table["columns"]).items()}
    # one select: codes and names may overlap, and names may hold dots
    kept = [c for c in df.columns if not (drop_errors and ", Error" in c)]
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(renamed.get(c, c).replace(":", "")) for c in kept])


def _same_columns(df: DataFrame) -> list[str]:
    """Columns whose values repeat those of an earlier one: equal hashes first, then compared."""
    names = [c for c in df.columns if c != "geoid"]
    q = lambda c: "`" + c.replace("`", "``") + "`"
    if not names:
        return []
    marks = df.agg(*[F.sum(F.xxhash64("geoid", F.col(q(c)).cast("string")).cast("decimal(38,0)")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    seen: dict = {}
    drop = []
    for i, c in enumerate(names):
        twin = seen.setdefault(marks[i], c)
        if twin != c and df.where(~F.col(q(twin)).cast("string").eqNullSafe(F.col(q(c)).cast("string"))).isEmpty():
            drop.append(c)
    return drop


def read_census(spark: SparkSession, folder: str, level: int | str | None = "auto", drop_errors: bool = True, suffix: str | Sequence[str] = ()) -> DataFrame:
    """One table by ``geoid`` from all folders below ``folder`` that hold a CSV and a JSON.

    ``level`` keeps ids of one length: that given, the commonest of each table
    ('auto', the shorter of equally common ones), or all (None). Columns get the
    names of the description with the headings above them, without colons, and
    on demand ``suffix`` facts ('id', 'years', 'name', 'table', 'title', ...). Margins
    of error are dropped, as are columns that repeat another's values. Ids missing
    from a table have null there. A name that an earlier table has already gets
    the number of its table.
    """
    facts = [suffix] if isinstance(suffix, str) else list(suffix)
    found = [_folder(spark, path, level, drop_errors, facts) for path, _, _ in sorted(os.walk(folder))]
    tables = [t for t in found if t is not None]
    if not tables:
        raise FileNotFoundError(f"no folder below {folder} holds both a CSV and a JSON file")
    out = tables[0]
    for k, table in enumerate(tables[1:], 2):
        out = out.join(table.toDF(*[c if c == "geoid" or c not in out.columns else f"{c}_{k}" for c in table.columns]), "geoid", "full_outer")
    return out.drop(*_same_columns(out))
