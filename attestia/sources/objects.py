"""A sink for named objects that never overwrites: create if absent, the same bytes are a success, other bytes a conflict.

Objects are rows of a table of commits. A `put` is written aside and becomes visible by one rename, so a task that is killed
and repeated, or a put that fails, leaves no object twice and none half. A put that has been renamed is recognised by its id and not
run again. One writer at a time, as for any table of files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of objects in each scope, with their kind and privacy tier.
_ID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
NAMES = {
    "submissions": {
        rf"(?i)^{_ID}\.json$": ("submission", "public"),
        rf"(?i)^comment-{_ID}\.json$": ("comment", "public"),
        rf"(?i)^{_ID}\.state\.json$": ("task-state", "public"),
    },
    "identities": {rf"(?i)^{_ID}\.json$": ("identity-envelope", "protected")},
}
OBJECT = "scope string, name string, content binary, sha256 string, kind string, tier string"


def described(scope: Column, name: Column) -> Column:
    """Kind and privacy tier of a name in its scope; null if it is none."""
    out = None
    for s, patterns in NAMES.items():
        for pattern, (kind, tier) in patterns.items():
            test, told = (scope == s) & name.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(tier).alias("tier"))
            out = F.when(test, told) if out is None else out.when(test, told)
    return out


class ObjectStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def objects(self) -> DataFrame:
        """All objects that have been put."""
        fs, p = self._fs(f"{self.path}/objects")
        return self.spark.read.schema(OBJECT).option("recursiveFileLookup", "true").parquet(f"{self.path}/objects") if fs.exists(p) else self.spark.createDataFrame([], OBJECT)

    def put(self, rows: DataFrame, put_id: str | None = None) -> DataFrame:
        """scope, name and outcome (created, same, conflict, invalid) of every row (scope, name, content).

        Of rows that give one name different bytes in the same put, those with the least digest are taken; null content is empty. A put
        with the id of an earlier one returns that one's outcomes.
        """
        put_id = put_id or uuid.uuid4().hex
        told = f"{self.path}/outcomes/{put_id}"
        fs, visible = self._fs(f"{self.path}/objects/{put_id}")
        _, aside = self._fs(f"{self.path}/aside/{put_id}")
        if not fs.exists(visible):
            content = F.coalesce("content", F.lit(b""))
            given = rows.select("scope", "name", content.alias("content"), F.sha2(content, 256).alias("sha256"), described(F.col("scope"), F.col("name")).alias("d"))
            key = ["scope", "name"]
            least = given.filter("d is not null").groupBy(*key).agg(F.min("sha256").alias("least"))
            held = self.objects().select(*key, F.col("sha256").alias("held"))
            judged = given.join(least, key, "left").join(held, key, "left")
            same = F.col("sha256") == F.coalesce("held", "least")
            outcome = F.when(F.col("d").isNull(), "invalid").when(~same, "conflict").when(F.col("held").isNotNull(), "same").otherwise("created")
            whole = judged.withColumn("outcome", outcome)
            whole.select(*key, "outcome").write.mode("overwrite").parquet(told)
            new = whole.filter("outcome = 'created'").groupBy(*key).agg(F.any_value("content").alias("content"), F.any_value("sha256").alias("sha256"), F.any_value("d").alias("d"))
            new.select(*key, "content", "sha256", "d.kind", "d.tier").write.mode("overwrite").parquet(f"{self.path}/aside/{put_id}")
            fs.mkdirs(visible.getParent())
            if not fs.rename(aside, visible):
                raise OSError(f"{put_id} could not be made visible")
        return self.spark.read.schema("scope string, name string, outcome string").parquet(told)
