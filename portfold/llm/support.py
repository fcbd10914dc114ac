"""What the operators of this package share."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portfold.sources.scratch import materialize, scratch_path

# Fixed value: the ASCII white space that parts words (\x20 and \x09 to \x0D).
WHITE_SPACE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: computed once, without lineage, safe when executors go."""
    return materialize(df, scratch_path(df.sparkSession, name))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns of these names in any case: the operator's own columns take their place."""
    taken = {name.lower() for name in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remainder_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1)).cast("int")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the whole text, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WHITE_SPACE}]+"), "")
