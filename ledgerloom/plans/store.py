"""Raw tables as Parquet: keyed commits of batches without a merge statement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.keyed import delete, upsert
from ledgerloom.plans.kept import hadoop_path

#: The key of each raw table.
KEYS = {"batch_lines": ["ID_BATCHLINE"], "checks_and_balances": ["ID_CAB"], "statement_heads": ["ID_STATEMENT"], "statement_lines": ["ID_TRANSACTION"], "batch_heads": ["ID_BATCH"]}


class Store:
    """Tables below a folder; each version of a table is a folder of its own, and a manifest names the current ones.

    Manifests are numbered files that are renamed into place, so a change of
    several tables is seen whole or not at all, a writer that is lost leaves the
    old state in force, and of two writers at once the second fails."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def _manifest(self) -> tuple[int, dict[str, str]]:
        """Number of the last manifest and the versions that it names."""
        at, files = hadoop_path(self.spark, self.path)
        found = files.globStatus(at.suffix("/manifest-*")) if files.exists(at) else None
        names = sorted(s.getPath().toString() for s in found or ())
        if not names:
            return 0, {}
        return int(names[-1].rsplit("-", 1)[1]), dict(r[0].split(" ", 1) for r in self.spark.read.text(names[-1]).collect())

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table if there is none or if its columns aren't the schema's."""
        version = self._manifest()[1].get(name)
        if version:
            df = self.spark.read.parquet(f"{self.path}/{name}/{version}")
            if set(df.columns) == set(self.schemas[name].fieldNames()):
                return df.select(*self.schemas[name].fieldNames())
        return self.spark.createDataFrame([], self.schemas[name])

    def replace(self, tables: dict[str, DataFrame]) -> None:
        """Put new versions of some tables in force, all at once."""
        number, versions = self._manifest()
        for name, df in tables.items():
            versions[name] = f"v-{uuid.uuid4().hex}"
            df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name])).write.parquet(f"{self.path}/{name}/{versions[name]}")
        draft, files = hadoop_path(self.spark, f"{self.path}/_draft-{uuid.uuid4().hex}")
        out = files.create(draft)
        out.write("".join(f"{n} {v}\n" for n, v in sorted(versions.items())).encode())
        out.close()
        target, _ = hadoop_path(self.spark, f"{self.path}/manifest-{number + 1:012d}")
        if files.exists(target) or not files.rename(draft, target):
            raise RuntimeError(f"{self.path}: another writer came first")

    def append(self, name: str, new: DataFrame) -> None:
        self.replace({name: self.read(name).unionByName(new.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name])))})

    def update(self, name: str, new: DataFrame) -> None:
        self.update_all({name: new})

    def update_all(self, tables: dict[str, DataFrame]) -> None:
        """Upsert rows by each table's key; a key twice among the new rows of a table is an error, and nothing is changed."""
        tables = {name: new for name, new in tables.items() if not new.isEmpty()}
        for name, new in tables.items():
            if not new.groupBy(*KEYS[name]).count().where("count > 1").isEmpty():
                raise ValueError(f"{name}: a key occurs twice in one commit")
        if tables:
            self.replace({name: upsert(self.read(name), new, KEYS[name]) for name, new in tables.items()})

    def delete(self, name: str, gone: DataFrame) -> None:
        self.replace({name: delete(self.read(name), gone, KEYS[name])})

    def truncate(self, name: str) -> None:
        self.replace({name: self.spark.createDataFrame([], self.schemas[name])})


def routed(batch: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What of a batch is committed: its lines and checks always, statements only where the result is a success."""
    good = batch["results"].where("result = 'SUCCESS'").select("ID_STATEMENT").distinct()
    only = lambda name: batch[name].join(good, "ID_STATEMENT", "left_semi")
    return {"batch_lines": batch["batch_lines"], "checks_and_balances": batch["checks_and_balances"], "statement_heads": only("statement_heads"), "statement_lines": only("statement_lines"), "batch_heads": batch["batch_heads"]}


def commit(store: Store, batch: dict[str, DataFrame], rebuild=None) -> bool:
    """Commit a batch, all tables at once, and rebuild the mart if any statement came in.

    A statement without a result is skipped alone; running a commit again changes nothing."""
    parts = routed(batch)
    store.update_all({name: parts[name] for name in KEYS})
    came = not parts["statement_heads"].isEmpty()
    if came and rebuild:
        rebuild()
    return came
