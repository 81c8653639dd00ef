"""Tables that change together: versions named by a manifest that is written last and read first."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Store:
    """Tables below a folder. A version is a manifest: for each table its schema and the folders that hold its rows, and what jobs
    have noted (``notes``). Rows are written first and nobody sees them; then the manifest gets its name by one rename, which shows
    all tables of the version at once. A job that dies before leaves folders that no manifest names (see ``vacuum``).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._fs(f"{self.root}/versions/*.json")
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.globStatus(path) or [])

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        version = version if version is not None else (have[-1] if have else 0)
        if version == 0:
            return {"version": 0, "tables": {}, "notes": {}}
        if version not in have:
            raise ValueError(f"there is no version {version}")
        return json.loads(self.spark.read.text(f"{self.root}/versions/{version:012d}.json", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version, or of the last. A table that the version does not have raises ValueError."""
        has = self.manifest(version)["tables"].get(table)
        if has is None:
            raise ValueError(f"there is no table {table}")
        schema = T.StructType.fromJson(has["schema"])
        if not has["folders"]:
            return self.spark.createDataFrame([], schema)
        if not has.get("partition"):
            return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in has["folders"]])
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/{f}") for f in has["folders"]]  # each finds partitions of its own
        return reduce(DataFrame.unionByName, parts).select(*schema.names)

    def commit(self, add: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, notes: dict | None = None, partition: dict[str, list[str]] | None = None) -> int:
        """One version more: rows added to some tables, others replaced, notes taken over; its number.

        All of it shows or nothing. A writer that was faster raises ValueError here; what it published stays. Rows to add must have the
        columns of their table. ``partition``: columns that name folders within a table, for all its rows from its first on.
        """
        base = self.manifest()
        tables = dict(base["tables"])
        for fresh, frames in ((False, add or {}), (True, replace or {})):
            for name, df in frames.items():
                old = None if fresh else tables.get(name)
                if old and {(f["name"], str(f["type"])) for f in old["schema"]["fields"]} != {(f["name"], str(f["type"])) for f in df.schema.jsonValue()["fields"]}:
                    raise ValueError(f"rows of {name} have other columns")
                folder = f"data/{name}/{uuid.uuid4().hex}"
                by = old.get("partition", []) if old else (partition or {}).get(name, [])
                df.write.partitionBy(*by).parquet(f"{self.root}/{folder}")
                tables[name] = {"schema": old["schema"] if old else df.schema.jsonValue(), "folders": [*(old["folders"] if old else []), folder], "partition": by}
        version = base["version"] + 1
        self._name(version, json.dumps({"version": version, "tables": tables, "notes": base["notes"] | (notes or {})}))
        return version

    def _name(self, version: int, text: str) -> None:
        jvm = self.spark._jvm
        path, fs = self._fs(f"{self.root}/versions/_{uuid.uuid4().hex}")
        out = fs.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/{version:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(path, final, none)  # fails where the name is taken
        except Exception as e:
            fs.delete(path, False)
            if not fs.exists(final):
                raise
            raise ValueError(f"version {version} was published by another writer") from e

    def compact(self, table: str) -> int:
        """The table in one folder again, as a version more; small batches leave many."""
        return self.commit(replace={table: self.read(table)}, partition={table: self.manifest()["tables"][table].get("partition", [])})

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """The table with other columns, made of its rows by ``change``, as a version more; readers of older versions see the old columns."""
        return self.commit(replace={table: change(self.read(table))})

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the last ``keep`` versions and delete what only they named or nobody does; how many folders went. No
        writer may be at work."""
        have = self.versions()
        for v in have[: len(have) - keep]:
            path, fs = self._fs(f"{self.root}/versions/{v:012d}.json")
            fs.delete(path, False)
        named = {f for v in have[len(have) - keep :] for t in self.manifest(v)["tables"].values() for f in t["folders"]}
        path, fs = self._fs(f"{self.root}/data/*/*")
        gone = [f.getPath() for f in fs.globStatus(path) or [] if "/".join(["data", f.getPath().getParent().getName(), f.getPath().getName()]) not in named]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def backfill(store: Store, name: str, source: DataFrame, watermark: str, make: Callable[[DataFrame, int], dict[str, DataFrame]], rows: int) -> int:
    """Load what of ``source`` lies after the watermark reached, in batches in its order; how many were loaded.

    A batch takes the next ``rows`` rows and all others of its last watermark. ``make`` (batch, number) gives rows to add to tables; they
    and the watermark are published together, so a load that fails is taken up where it stopped and no row is loaded
    twice. Watermarks are numbers or texts; rows without one are never loaded.
    """
    kind, loaded = source.schema[watermark].dataType, 0
    while True:
        note = store.manifest()["notes"].get(name, {"last": None, "batch": 0})
        rest = source.where(F.col(watermark).isNotNull())
        if note["last"] is not None:
            rest = rest.where(F.col(watermark) > F.lit(note["last"]).cast(kind))
        upto = rest.select(watermark).orderBy(watermark).limit(rows).agg(F.max(watermark)).first()[0]
        if upto is None:
            return loaded
        number = note["batch"] + 1
        batch = rest.where(F.col(watermark) <= F.lit(upto).cast(kind))
        store.commit(add=make(batch, number), notes={name: {"last": upto, "batch": number}})
        loaded += 1
