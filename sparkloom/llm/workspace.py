"""Tables and small driver-side facts shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import shared_dir


class Workspace:
    """Written tables that cut lineage: each is Parquet in the shared folder, so a lost executor costs
    a retry of its tasks and never a recomputation of everything before."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.files = None  #: most files of a narrow table, once the number of rows is known
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def sized_for(self, rows: int, per_file: int = 250_000) -> None:
        """Narrow tables follow the number of rows, not the number of shuffle partitions."""
        self.files = max(8, -(-rows // per_file))

    def narrow(self, df: DataFrame, name: str) -> DataFrame:
        return self.save(df.coalesce(self.files) if self.files else df, name)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(_nullable(df.schema)).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most parts - 1 ascending cut points that split an integer column evenly."""
    if parts < 2:
        return []
    cuts = df.select(F.percentile_approx(F.col(column), F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)]), F.lit(max(10_000, 20 * parts)))).first()[0]
    return sorted({int(x) for x in cuts or []})


def bucket_of(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are below the column, by a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column > bounds[middle], tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(bounds))
