"""Several tables that change together. A version is a manifest that names each table's files; it becomes visible by one rename.

``data/<table>/<id>`` holds the files, which never change; ``versions/<n>.json`` the manifests. A commit writes new files that
nobody reads yet, then its manifest under a name of its own, and renames that to the next number. The rename fails if another
commit has taken the number: of two commits that started from one version, one wins and the other raises ``Conflict``. A job
that dies before the rename leaves the last version as it was. Readers keep the version that they began with."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit has made the version that this one was to make."""


class Versioned:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._place("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The numbers of all versions, in order."""
        fs, place = self._files(), self._place("versions")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n[:1].isdigit())

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if not n:
            return {"tables": {}, "batch": None}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{n}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = self.manifest(version)["tables"][name]
        return self.spark.read.schema(T.StructType.fromJson(found["schema"])).parquet(f"{self.path}/{found['folder']}")

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        n = self.version() if version is None else version
        return {name: self.read(name, n) for name in self.manifest(n)["tables"]}

    def committed(self, batch: str) -> int | None:
        """The version that a batch made, if it did."""
        if not self.versions():
            return None
        each = self.spark.read.text(f"{self.path}/versions/[0-9]*.json", wholetext=True)
        hit = each.filter(F.get_json_object("value", "$.batch") == batch).select(F.min(F.get_json_object("value", "$.version").cast("long"))).first()
        return hit[0]

    def commit(self, tables: Mapping[str, DataFrame], *, expected: int, batch: str | None = None) -> int:
        """Makes version ``expected + 1``: the tables given, and the others as they were. A batch that was committed already
        isn't written again: its version is returned."""
        if batch is not None and (done := self.committed(batch)) is not None:
            return done
        files = dict(self.manifest(expected)["tables"])
        for name, df in tables.items():
            folder = f"data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            files[name] = {"folder": folder, "schema": df.schema.jsonValue()}
        self._publish(expected + 1, {"version": expected + 1, "batch": batch, "tables": files})
        return expected + 1

    def _publish(self, version: int, manifest: dict) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        draft, final = self._place(f"versions/_{uuid.uuid4().hex}"), self._place(f"versions/{version}.json")
        out = self._files().create(draft, False)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(conf).getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(draft, final, none)
        except Exception as e:
            self._files().delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"version {version} is there already") from e
            raise

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes all but the last ``keep`` versions, and files that no version names any more; the folders that went. Not
        while a commit is running: its files aren't named yet."""
        fs, every = self._files(), self.versions()
        stay = {found["folder"] for n in every[-keep:] for found in self.manifest(n)["tables"].values()}
        for n in every[:-keep]:
            fs.delete(self._place(f"versions/{n}.json"), False)
        gone = []
        for table in fs.listStatus(self._place("data")):
            for folder in fs.listStatus(table.getPath()):
                name = f"data/{table.getPath().getName()}/{folder.getPath().getName()}"
                if name not in stay:
                    fs.delete(folder.getPath(), True)
                    gone.append(name)
        return sorted(gone)
