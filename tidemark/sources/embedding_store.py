"""A content-addressed store of text vectors with a manifest of committed parts.

A vector's key is its entity, the digest of the text it was made from, and the encoder's name. Parts are folders of Parquet; only
parts that a manifest names belong to the store, so what a failed or repeated run left behind is not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ENTITY
from ..operators.vectors import Encoder, embed_text
from ..session import stage

SCHEMA = "entity_id BIGINT, digest STRING, encoder STRING, vec ARRAY<DOUBLE>"
KEY = ["entity_id", "digest", "encoder"]


def text_digest(text: str | Column) -> Column:
    """SHA-256 of a text; a null text counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


class EmbeddingStore:
    """Vectors below ``path``, a folder every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop
        self._path, self._conf = hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    # --- the manifest: file n holds the list of parts after n commits --------------------------------

    def version(self) -> int:
        """Number of commits."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.path}/manifest/{version:08d}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, parts: list[str]) -> bool:
        """Make ``parts`` the list after ``version`` commits; false if another writer was first.

        The list is written aside and renamed to a name that must be free, which a file system does in one step.
        """
        target = self._path(f"{self.path}/manifest/{version + 1:08d}")
        aside = self._path(f"{self.path}/aside/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(aside, False)
        self._io.write(json.dumps(parts), stream, "UTF-8")
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
        try:
            options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(aside, target, options)
            return True
        except Exception as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise

    # --- rows ----------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """All committed vectors, as of a version if one is given."""
        parts = [f"{self.path}/parts/{p}" for p in self.parts(version)]
        return self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def append(self, vectors: DataFrame) -> int:
        """Commit those of the vectors (columns as :data:`SCHEMA`) whose key is not in the store; how many were.

        The rows are written as a part first and named by the manifest then. If another writer committed meanwhile, what it added is
        taken out of the part and the commit tried again on top. A key that is given twice is stored once. Nulls in a key match nulls.
        """
        fresh = vectors.select(*KEY, "vec").dropDuplicates(KEY)
        seen = self.version()
        part = self._missing(fresh, self.read(seen))
        while True:
            name = uuid.uuid4().hex
            written = stage(part, "part", f"{self.path}/parts/{name}")
            added = written.count()
            if not added:
                return 0
            if self._commit(seen, [*self.parts(seen), name]):
                return added
            seen = self.version()
            part = self._missing(written, self.read(seen))

    @staticmethod
    def _missing(rows: DataFrame, stored: DataFrame) -> DataFrame:
        known = stored.select(*[F.col(c).alias(f"_{c}") for c in KEY])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
        return rows.join(known, same, "left_anti")

    def update(
        self, docs: DataFrame, make_encoder: Callable[[], Encoder], encoder: str, text: str = "to_tok", tasks: int | None = None
    ) -> int:
        """Encode the texts the store has no vector of and commit them; how many those were.

        ``docs`` holds ``entity_id`` and the text; an entity may have several. An entity whose text changed gets a vector more, one
        whose text did not is not encoded. Keys are looked up before anything is encoded.
        """
        keyed = docs.select(ENTITY, F.col(text).alias("text"), text_digest(text).alias("digest"), F.lit(encoder).alias("encoder"))
        lacking = stage(self._missing(keyed.select(*KEY).distinct(), self.read()), "lacking")
        if lacking.isEmpty():
            return 0
        wanted = lacking.select(*[F.col(c).alias(f"_{c}") for c in KEY])
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
        todo = keyed.join(wanted, same, "left_semi").dropDuplicates(KEY)
        made = embed_text(todo.select(F.struct(ENTITY, "digest", "encoder").alias(ENTITY), "text"), make_encoder, "text", tasks)
        return self.append(made.select(f"{ENTITY}.*", "vec"))

    def current(self, docs: DataFrame, encoder: str, text: str = "to_tok") -> DataFrame:
        """``entity_id, vec`` of the texts that ``docs`` holds now; texts not in the store are left out."""
        wanted = docs.select(ENTITY, text_digest(text).alias("digest"), F.lit(encoder).alias("encoder")).distinct()
        return wanted.join(self.read(), KEY).select(ENTITY, "vec")
