"""What the operators share: shared scratch tables, sampled splitters and hot-key joins."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from bisect import bisect_left

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, as a character class.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs on one machine, a folder of our own, set there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sediment-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends here and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sediment/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each led by as many underscores as it takes to be none of the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


#: Most files whose numbers are broadcast.
FEW_FILES = 4096


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a long of its own for each row, the same whenever it is read again: the file's number and the row's place
    in it where df reads Parquet files; else, or with more than FEW_FILES files, df is written with its numbers first."""
    path, at, number = fresh([*df.columns, name], "path", "at", "number")
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(at))
        files = [r[0] for r in placed.select(path).distinct().limit(FEW_FILES + 1).collect()]
    except AnalysisException:
        files = None
    if files is None or len(files) > FEW_FILES:
        return stored(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
    numbers = df.sparkSession.createDataFrame(list(zip(sorted(files), range(len(files)))), f"{path} string, {number} long")
    row = F.shiftleft(number, 40) + F.col(at)
    return placed.join(F.broadcast(numbers), path).withColumn(name, row).drop(path, at, number)


def trim() -> None:
    """Gives what a Python worker has freed back to the system, so that its next stage starts small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: At most so many keys are ever broadcast as heavy ones: each holds over 1/HEAVY of the rows.
HEAVY = 1024


def join_hot(rows: DataFrame, dim: DataFrame, key: str | list[str], count: str, how: str = "left") -> DataFrame:
    """rows joined with dim (one row for each key, with its number of rows in column count), safe for hot keys.

    Keys that hold over 1/1024 of all rows are at most 1024, so their part of dim is broadcast whatever the input's
    size; the other keys are joined by shuffle. rows and dim should be stored tables, as both are read twice.
    """
    total = dim.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(max(total // HEAVY, 1000))
    heavy, light = F.broadcast(dim.where(hot)), dim.where(~hot)
    keys = [key] if isinstance(key, str) else key
    names = [c for c in dim.columns if c not in keys]
    through = rows.join(heavy, keys, "inner")
    rest = rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, how)
    return through.select(*rows.columns, *names).unionByName(rest.select(*rows.columns, *names))


# --- ranges by sampled splitters -------------------------------------------------------------------------------------


def point_sample(keys: DataFrame, cols: list[str], size: str, points: int, total: int) -> list[tuple]:
    """(key, points) of about `points` sample points dealt over the rows in proportion to their size; sorted by key."""
    u = F.pmod(F.xxhash64(F.lit("points"), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = F.floor(F.col(size) * F.lit(points / max(total, 1)) + u).cast("long").alias("n")
    found = keys.select(*cols, n).where("n > 0").collect()
    return sorted((tuple(r)[:-1], r["n"]) for r in found)


def quantiles(sample: list[tuple], parts: int) -> list[tuple]:
    """Boundaries of `parts` ranges of near-equal points: the key of each quantile, once."""
    total, run, out = sum(n for _, n in sample), 0, []
    for key, n in sample:
        run += n
        while len(out) < parts - 1 and run * parts >= total * (len(out) + 1):
            out.append(key)
    return sorted(set(out))


def range_index(cols: list[str], bounds: list[tuple]) -> Column:
    """How many boundaries lie below the row's key (non-null longs), found in two steps of about sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    lit = lambda k: f"struct({', '.join(f'bigint({v!r}) as k{i}' if v > -(1 << 63) else f'-9223372036854775808L as k{i}' for i, v in enumerate(k))})"
    key = f"struct({', '.join(f'{c} as k{i}' for i, c in enumerate(cols))})"
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = f"size(filter(array({', '.join(lit(b[-1]) for b in blocks)}), b -> b < {key}))"
    fine = f"array({', '.join(f'array({", ".join(map(lit, b))})' for b in blocks)})"
    rest = len(bounds) - len(blocks) * step
    return F.expr(f"int(coalesce(size(filter(get({fine}, {coarse}), b -> b < {key})), {rest}) + {step} * {coarse})")


def split_ranges(keys: DataFrame, cols: list[str], size: str, parts: int, points: int, rounds: int = 8) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Boundaries of about `parts` ranges of near-equal size, and (size, rows) of each range as it really is.

    Splitters are quantiles of a size-weighted sample (about `points` keys on the driver, whatever the input's size). A
    range that holds more than twice its share in several rows is sampled again by itself and subdivided.
    """
    total, sample, bounds = keys.agg(F.sum(size)).first()[0] or 0, None, []
    sample = point_sample(keys, cols, size, points, total)
    bounds = quantiles(sample, parts)
    for _ in range(rounds):
        ranged = keys.withColumn("_r", range_index(cols, bounds))
        found = {r["_r"]: (r["s"], r["n"]) for r in ranged.groupBy("_r").agg(F.sum(size).alias("s"), F.count("*").alias("n")).collect()}
        share = max(1, total / parts)
        over = [r for r, (s, n) in found.items() if s > 2 * share and n > 1]
        more: set[tuple] = set()
        if over:
            own = point_sample(ranged.where(F.col("_r").isin(over)), cols, size, points, sum(found[r][0] for r in over))
            by: dict[int, list] = {}
            for key, n in own:
                by.setdefault(bisect_left(bounds, key), []).append((key, n))
            for r, part in by.items():
                more |= set(quantiles(part, 2 + int(found[r][0] / share))) if r in found else set()
        if not more - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    return bounds, [found.get(i, (0, 0)) for i in range(len(bounds) + 1)]
