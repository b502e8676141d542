"""An index of all pages of an ordered table, so that any page is read by its bounds and nothing is sorted again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from weftline.operators.changes import bounded_batches
from weftline.operators.ordinals import settled, with_ordinals


@dataclass(frozen=True)
class PageIndex:
    """``bounds`` has a row for each page: page (from 0), first_ordinal, n, bytes, and its first and last keys."""

    order: list[str]
    bounds: DataFrame

    def read(self, table: DataFrame, page: int) -> DataFrame:
        """The rows of a page, in order: those between its first and last key.  A page beyond the last has none."""
        found = self.bounds.filter(F.col("page") == page).first()
        if found is None:
            return table.limit(0)
        return table.filter(self._from(found["first"]) & self._upto(found["last"])).orderBy(*self.order)

    def page_of(self, *key: object) -> int | None:
        """The page that a key lies in, or would lie in behind the last key before it; None before the first."""
        at = Row(**dict(zip(self.order, key)))
        return self.bounds.filter(_compare(F.col("first"), at, self.order, below=True)).agg(F.max("page")).first()[0]

    def _from(self, key: Row) -> Column:
        # the first column alone can be pushed into the scan
        return (F.col(self.order[0]) >= F.lit(key[0])) & _later(key, self.order)

    def _upto(self, key: Row) -> Column:
        return (F.col(self.order[0]) <= F.lit(key[0])) & _sooner(key, self.order)


def _later(key: Row, order: list[str]) -> Column:
    out = F.lit(True)
    for name, value in reversed(list(zip(order, key))):
        out = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def _sooner(key: Row, order: list[str]) -> Column:
    out = F.lit(True)
    for name, value in reversed(list(zip(order, key))):
        out = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & out)
    return out


def _compare(struct: Column, key: Row, order: list[str], below: bool) -> Column:
    out = F.lit(True)
    for name, value in reversed(list(zip(order, key))):
        less = struct[name] < F.lit(value) if below else struct[name] > F.lit(value)
        out = less | ((struct[name] == F.lit(value)) & out)
    return out


def page_index(table: DataFrame, order: list[str], max_rows: int, max_bytes: int | None = None, size: Column | None = None) -> PageIndex:
    """Pages as long as they have at most ``max_rows`` rows and, with ``size``, ``max_bytes``; a row that alone is larger is a page.

    ``order`` is ascending, without nulls and without ties (else it is an error when the index is built).  Rows are
    numbered over ranges, so there is one sort, of narrow rows, for all pages.
    """
    if max_rows < 1 or (max_bytes is None) != (size is None):
        raise ValueError("a page holds at least one row, and a bound of bytes needs the size of a row")
    bad = F.lit(False)
    for c in order:
        bad = bad | F.col(c).isNull()
    checked = F.when(bad, F.raise_error(F.lit("the order of pages has a null"))).otherwise(size.cast("long") if size is not None else F.lit(0).cast("long"))
    numbered = settled(with_ordinals(table.select(*order, checked.alias("__size")), [F.col(c) for c in order], "__at"))
    if size is None:
        paged = numbered.withColumn("page", F.floor(F.col("__at") / max_rows).cast("long"))
    else:
        cut = bounded_batches(numbered.select(F.col("__at").alias("row_ordinal"), F.col("__size").alias("size")), max_rows, max_bytes)
        paged = numbered.join(cut.select(F.col("row_ordinal").alias("__at"), F.col("batch").alias("page")), "__at")
    key = F.struct(*order)
    twice = F.when(F.count_distinct(key) < F.count("*"), F.raise_error(F.lit("the order of pages has ties")).cast("long")).otherwise(F.count("*"))
    bounds = paged.groupBy("page").agg(F.min("__at").alias("first_ordinal"), twice.alias("n"), F.sum("__size").alias("bytes"), F.min(key).alias("first"), F.max(key).alias("last"))
    return PageIndex(order, settled(bounds))
