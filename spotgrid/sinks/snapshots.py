"""Tables saved by step, one ``step=N`` directory each, listed in a manifest.

A snapshot is written beside the others under a hidden name, moved to its place,
and then entered in the manifest, which is replaced as a whole: readers see the
steps of the manifest only, so a step that was not finished, or is being written
again, never shows.  Only the last ``keep`` snapshots stay, if that is given.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_manifest.json"


def _folder(spark: SparkSession, path: str):
    """Hadoop path and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_manifest(spark: SparkSession, path: str) -> dict[int, dict] | None:
    """Entries by step; None for a folder without a manifest."""
    file, fs = _folder(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {int(step): entry for step, entry in json.loads(text).items()}


def _write_manifest(spark: SparkSession, path: str, entries: dict[int, dict]) -> None:
    """Replace the manifest in one move."""
    jvm = spark.sparkContext._jvm
    base = path.rstrip("/")
    fresh, fs = _folder(spark, f"{base}/_manifest-{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(json.dumps({str(s): e for s, e in sorted(entries.items())}).encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, _folder(spark, f"{base}/{MANIFEST}")[0], over)


def _delete(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def write_snapshot(df: DataFrame, path: str, step: int, every: int = 1, keep: int | None = None) -> bool:
    """Write when ``step`` is a multiple of ``every`` (step 0 writes); returns whether it did.

    A step that is written again replaces the earlier one once it is complete.  With
    ``keep``, all but the ``keep`` highest steps are removed afterwards.
    """
    if step % every:
        return False
    if keep is not None and keep < 1:
        raise ValueError("at least one snapshot is kept")
    spark, base = df.sparkSession, path.rstrip("/")
    name = f"step={step}"
    hidden = f"{base}/_{name}-{uuid.uuid4().hex}"
    df.write.parquet(hidden)
    entries = _read_manifest(spark, base) or {s: {"folder": f"step={s}"} for s in saved_steps(spark, base)}
    source, fs = _folder(spark, hidden)
    earlier = entries.get(step)
    # A folder of that name may be in use or left by a crash; the new one then gets a name of its own.
    place = name if not fs.exists(_folder(spark, f"{base}/{name}")[0]) else f"{name}-{uuid.uuid4().hex}"
    if not fs.rename(source, _folder(spark, f"{base}/{place}")[0]):
        raise OSError(f"{hidden} cannot be moved to {place}")
    entries[step] = {"folder": place}
    dropped = sorted(entries)[:-keep] if keep is not None else []
    gone = [entries.pop(s)["folder"] for s in dropped]
    _write_manifest(spark, base, entries)
    for folder in gone + ([earlier["folder"]] if earlier else []):
        _delete(spark, f"{base}/{folder}")
    return True


def saved_steps(spark: SparkSession, path: str) -> list[int]:
    """Steps with a completed snapshot, ascending."""
    entries = _read_manifest(spark, path)
    if entries is not None:
        return sorted(entries)
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    steps = []
    for status in fs.listStatus(folder):
        match = re.fullmatch(r"step=(\d+)", status.getPath().getName())
        if match and fs.exists(_folder(spark, f"{status.getPath()}/_SUCCESS")[0]):
            steps.append(int(match.group(1)))
    return sorted(steps)


def latest_step(spark: SparkSession, path: str) -> int | None:
    """Highest completed step, or None."""
    steps = saved_steps(spark, path)
    return steps[-1] if steps else None


def load_snapshot(spark: SparkSession, path: str, step: int | None = None) -> DataFrame:
    """Read one step, by default the latest; a missing snapshot is an error."""
    steps = saved_steps(spark, path)
    chosen = step if step is not None else (steps[-1] if steps else None)
    if chosen is None or chosen not in steps:
        raise FileNotFoundError(f"no snapshot {'' if step is None else step} in {path}")
    entry = (_read_manifest(spark, path) or {}).get(chosen, {"folder": f"step={chosen}"})
    return spark.read.parquet(f"{path.rstrip('/')}/{entry['folder']}")


def tidy(spark: SparkSession, path: str) -> int:
    """Remove what crashed writers left in a snapshot folder; returns how many folders went.

    No writer may be at work in it.
    """
    entries = _read_manifest(spark, path)
    folder, fs = _folder(spark, path)
    if entries is None or not fs.exists(folder):
        return 0
    wanted = {e["folder"] for e in entries.values()}
    gone = 0
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name not in wanted and re.fullmatch(r"_step=\d+-[0-9a-f]+|_manifest-[0-9a-f]+|step=\d+(-[0-9a-f]+)?", name):
            fs.delete(status.getPath(), True)
            gone += 1
    return gone


def prepare_results(spark: SparkSession, path: str, clear: bool = False) -> None:
    """Make the results folder; one that is not empty is cleared only on request."""
    folder, fs = _folder(spark, path)
    if fs.exists(folder) and len(fs.listStatus(folder)):
        if not clear:
            raise FileExistsError(f"{path} is not empty")
        fs.delete(folder, True)
    fs.mkdirs(folder)
