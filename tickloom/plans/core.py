"""Relations: named, composable plans over DataFrames.

A Relation is a SQL text with its inputs in braces; calling it with DataFrames gives a DataFrame, planned as one
Catalyst tree with all that it is built from. The text is kept to what Spark and other engines share; the few functions
whose names differ are written with an @ and rendered by dialect, so the same definition can be compiled to one
statement for an independent engine. A Native relation has a Spark function (a stateful kernel, say) and, if SQL can
say the same, a separate statement to compare it with.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: What Spark and the comparison engine name differently.
_SPARK = {"@percentile(": "percentile(", "@days(": "datediff(", "@list(": "array(", "@text": "STRING", "@arg_first(": "min_by(", "@pair(": "struct(", "@format(": "format_string(", "@sha256(body)": "sha2(body, 256)"}
_DUCK = {"@percentile(": "quantile_cont(", "@list(": "list_value(", "@text": "VARCHAR", "@arg_first(": "min_by(", "@pair(": "row(", "@format(": "printf(", "@sha256(body)": "sha256(body)"}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
RELATIONS: dict[str, "Relation | Native"] = {}


def q(x: str, digits: int = 4) -> str:
    """SQL that quantizes a double alike in any engine; the odd offset keeps ties off values that prices can have."""
    n = 10**digits
    return f"CAST(floor(({x}) * {n} + 0.4137) AS DOUBLE) / {n}"


def half_even(x: str, digits: int = 1) -> str:
    """SQL that rounds a double to so many digits, ties to the even one."""
    n = f"(({x}) * {10**digits})"
    return f"CASE WHEN abs({n} - floor({n}) - 0.5) < 1e-7 THEN CAST(floor({n} / 2 + 0.5) * 2 AS DOUBLE) ELSE CAST(floor({n} + 0.5) AS DOUBLE) END / {10**digits}"


def render(sql: str, dialect: str) -> str:
    for a, b in (_SPARK if dialect == "spark" else _DUCK).items():
        sql = sql.replace(a, b)
    if dialect == "spark":
        sql = re.sub(r"OVER (w\d*)\b", r"OVER (\1)", sql)  # a bare name would swallow a minus that follows
    else:
        sql = re.sub(r"@days\(([^,()]+), ([^()]+?)\)", r"date_diff('day', \2, \1)", sql)
    return sql


def _inputs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


@dataclass
class Relation:
    """oracle: a statement of its own to compare the rows with; without one the text is rendered for the other engine."""

    name: str
    sql: str
    inputs: list[str] = field(default_factory=list)
    oracle: str | None = None

    def __post_init__(self):
        self.inputs = _inputs(self.sql)
        RELATIONS[self.name] = self

    def __call__(self, **frames: DataFrame) -> DataFrame:
        spark = next(iter(frames.values())).sparkSession
        return spark.sql(render(self.sql, "spark"), **{k: frames[k] for k in self.inputs})


@dataclass
class Native:
    """reads: how often the function reads each of its inputs."""

    name: str
    function: Callable[..., DataFrame]
    inputs: list[str]
    oracle: str | None = None
    reads: int = 2

    def __post_init__(self):
        RELATIONS[self.name] = self

    def __call__(self, **frames: DataFrame) -> DataFrame:
        return self.function(**{k: frames[k] for k in self.inputs})


#: Relations that cost much and are read by several others. Where a query reads one more than once it is written
#: once: the plan stays small, its exchanges run once, and a lost executor costs a reread.
KEEP = {"bars", "atom_masks_allowed", "macd_rows", "score_rows", "atom_masks", "wide_masks", "front_pool", "front_masks", "front_left", "fronts", "factors", "factor_values", "composite", "replay_rows", "accounts", "adjusted_rows", "rebalance_ranks"}
#: Of these, what is next read by window or group of its code: buckets of code, so no reader deals the rows again.
BUCKETED = {"bars", "macd_rows", "score_rows", "wide_masks", "adjusted_rows", "atom_masks_allowed", "replay_rows"}


def variant(name: str, suffix: str, swap: dict[str, str]) -> str:
    """Registers the relation, and all below it that reads an input named in ``swap``, over other inputs: name__suffix.

    So rules are stated once and run on raw or adjusted bars alike. Returns the new name (or the old, if nothing changes).
    """
    if name in swap:
        return swap[name]
    r = RELATIONS.get(name)
    if r is None:
        return name
    statement_inputs = _inputs(r.oracle) if r.oracle else []
    names = {i: variant(i, suffix, swap) for i in dict.fromkeys([*r.inputs, *statement_inputs])}
    if all(a == b for a, b in names.items()):
        return name
    new = f"{name}__{suffix}"
    if new not in RELATIONS:
        rename = lambda sql: sql and re.sub(r"\{(\w+)\}", lambda m: "{" + names[m[1]] + "}", sql)
        if isinstance(r, Relation):
            Relation(new, rename(r.sql), oracle=rename(r.oracle))
        else:
            Native(new, lambda **frames: r.function(**{i: frames[names[i]] for i in r.inputs}), [names[i] for i in r.inputs], rename(r.oracle), r.reads)
    return new


@functools.cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="tickloom-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def keep(df: DataFrame, name: str, bucketed: bool = False) -> DataFrame:
    """df, written to and read from the folder that driver and executors share (a local one only where none is set).

    The table goes when the driver ends. bucketed: rows whose tasks hold whole codes are written in buckets of code.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _local_folder()
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if bucketed:
        table = f"tickloom_{re.sub('[^a-z0-9]', '_', path.rsplit('/', 1)[1])}"
        atexit.register(_drop, spark, table)
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "code").sortBy("code", "d").format("parquet").option("path", path).saveAsTable(table)
        return spark.table(table)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # as below
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended; nothing depends on the removal
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def uses(name: str, found: dict[str, int] | None = None) -> dict[str, int]:
    """How often each relation below ``name`` is read."""
    found = {} if found is None else found
    r = RELATIONS.get(name)
    for i in r.inputs if r else ():
        first = i not in found
        found[i] = found.get(i, 0) + (r.sql.count(f"{{{i}}}") if isinstance(r, Relation) else r.reads)
        if first:
            uses(i, found)
    return found


def build(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None, read: dict[str, int] | None = None) -> DataFrame:
    """The relation over the tables of a folder; each input is planned once.

    Both sides of a join on code and day are dealt by code already, which is enough for Spark once it is told so.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    made = {} if made is None else made
    read = uses(name) if read is None else read
    if name not in made:
        if name in TABLES:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            r = RELATIONS[name]
            df = r(**{i: build(spark, sf_dir, i, made, read) for i in r.inputs})
            base = name.split("__")[0]
            made[name] = keep(df, name, base in BUCKETED) if base in KEEP and read.get(name, 0) > 1 else df
    return made[name]


def statement(name: str) -> str | None:
    """One SQL statement for the relation and all it is built from; None if SQL can't say a part of it."""
    parts: dict[str, str] = {}

    def visit(n: str) -> bool:
        if n in parts or n in TABLES:
            return True
        r = RELATIONS[n]
        sql = r.oracle or r.sql if isinstance(r, Relation) else r.oracle
        if sql is None or not all(visit(i) for i in _inputs(sql)):
            return False
        parts[n] = render(re.sub(r"\{(\w+)\}", r"\1", sql), "duck")
        return True

    if not visit(name):
        return None
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS (\n{s}\n)" for n, s in parts.items()) + f"\nSELECT * FROM {name}"
