"""Loading relational tables: cleaning, first row per key, insert-if-absent, key checks, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from oppsearch import schemas as S
from oppsearch.functions import clean as C
from oppsearch.session import written
from oppsearch.sources.tables import append_table, create_table, read_table


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row per key in ascending ``order``. An aggregate rather than a window: each map task sends at most one row
    per key, so a key that holds a third of the rows costs no more than any other."""
    others = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return first.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``."""
    return new.join(existing.select(*keys), keys, "left_anti")


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str],
                     order: list[str | Column]) -> DataFrame:
    """The rows an insert that skips present keys would add: first new row per absent key."""
    return absent(keep_first(new, keys, order), existing, keys)


def fk_violations(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows that name a missing parent. A NULL foreign key violates nothing."""
    parents = parent.select(F.col(pk).alias(fk))
    return child.filter(F.col(fk).isNotNull()).join(parents, fk, "left_anti").select(child.columns)


def require_fk(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> None:
    if not fk_violations(child, parent, fk, pk).isEmpty():
        raise ValueError(f"{fk} names rows that are missing from the parent table")


def key_checks(df: DataFrame, key: str, not_null: list[str]) -> DataFrame:
    """One row: row and key counts, keys used more than once, and NULLs per required column."""
    per_key = df.groupBy(key).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in not_null])
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(key).alias("n_keys"),
        F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("n_duplicate_keys"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in not_null])


def surrogate_ids(new: DataFrame, key: str, existing: DataFrame, id_col: str) -> DataFrame:
    """Dense ids above the largest stored id, in order of the hashed key.

    The hash prefix cuts the rows into up to 65,536 ranges that are numbered on their own; only
    one count per range goes through the window that adds up the offsets. ``key`` must be unique.
    """
    hashed = new.withColumn("_h", F.md5(F.col(key).cast("string")))
    hashed = hashed.withColumn("_range", F.left("_h", F.lit(4)))
    counts = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("m"))
    in_range = F.row_number().over(W.partitionBy("_range").orderBy("_h", key))
    return (hashed.withColumn("_in", in_range).join(offsets, "_range")
            .select((top.scalar() + F.col("_off") + F.col("_in")).alias(id_col), *new.columns))


def clean_programs(raw: DataFrame, strict: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    c = F.col
    return raw.select(
        *carry,
        C.clean_int(c("id"), strict).alias("id"),
        *[C.clean_str(c(n)).alias(n) for n in ("program_name", "university_name", "field_category")],
        C.clean_date(c("deadline_ir"), strict).alias("deadline_ir"),
        C.clean_date(c("deadline_non_ir"), strict).alias("deadline_non_ir"),
        C.clean_str(c("funding_type")).alias("funding_type"))


def clean_finances(raw: DataFrame, strict: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    c = F.col
    return raw.select(
        *carry,
        *[C.clean_int(c(n), strict).alias(n) for n in (
            "university_id", "tuition_fee_eu_per_year", "tuition_fee_non_eu_per_year")],
        C.clean_bool(c("scholarship_available")).alias("scholarship_available"),
        *[C.json_string_array(c(n)).alias(n) for n in ("funding_category", "urls")])


def load_split(raw: DataFrame, kind: str, carry: tuple[str, ...] = ()
               ) -> tuple[DataFrame, DataFrame]:
    """Lenient load: ``(clean, rejects)``. A raw row is rejected when a required cell is blank or
    a number or date cell holds text that does not parse; the reject keeps the raw cells and names
    the columns at fault. ``carry``: columns that go with the clean rows as they are."""
    required, ints, dates = {
        "programs": (["id", "program_name", "university_name"], ["id"],
                     ["deadline_ir", "deadline_non_ir"]),
        "finances": (["university_id"],
                     ["university_id", "tuition_fee_eu_per_year", "tuition_fee_non_eu_per_year"],
                     []),
    }[kind]
    cells = [n for n in raw.columns if n not in carry]
    both = raw.select(F.struct(*cells).alias("raw"), *carry,
                      *[C.clean_str(F.col(n)).alias(n) for n in cells])
    c = F.col
    bad = F.concat_ws(
        ",",
        *[F.when(c(n).isNull(), n) for n in required],
        *[F.when(c(n).isNotNull() & c(n).try_cast("int").isNull(), n) for n in ints],
        *[F.when((F.upper(n) != "NULL") & c(n).try_cast("date").isNull(), n) for n in dates])
    checked = both.withColumn("bad_columns", bad)
    good = checked.filter(c("bad_columns") == "").select(*carry, *cells)
    rejects = checked.filter(c("bad_columns") != "").select("raw.*", *carry, "bad_columns")
    clean = clean_programs if kind == "programs" else clean_finances
    return clean(good, carry=carry), rejects


def file_place() -> Column:
    """Where a row of a file scan stands: file, part of the file, row."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start",
                    F.monotonically_increasing_id().alias("row"))


def load_table(raw: DataFrame, kind: str, folder: str, parent: DataFrame | None = None) -> None:
    """Insert the rows of a file scan, or of a read in ranges, whose key is not stored yet into ``folder``/rows, of rows
    with one key the first in file order, and write the scan's rejected rows to ``folder``/rejects, each
    file's in a part of their own: a file that is loaded again replaces its own and no other's.

    ``parent``: the programs that finance rows must name; a missing one is an error before anything
    is written.
    """
    spark = raw.sparkSession
    schema, key = {"programs": (S.PROGRAMS, "id"), "finances": (S.FINANCES, "university_id")}[kind]
    create_table(spark, f"{folder}/rows", schema)
    create_table(spark, f"{folder}/rejects/file=none", ", ".join(
        f"{n} STRING" for n in (*raw.columns, "bad_columns") if n != "_place"))
    # rows and rejects both need the scan; a read in ranges goes through Python, so it is made once
    placed = (written(raw, "raw-rows") if "_place" in raw.columns else
              raw.withColumn("_place", file_place()))
    good, rejects = load_split(placed, kind, ("_place",))
    present = read_table(spark, f"{folder}/rows", schema)
    new = insert_if_absent(good, present, [key], ["_place"]).drop("_place")
    if parent is not None:
        require_fk(new, parent, key, "id")
    (rejects.withColumn("file", F.md5("_place.file_path")).drop("_place").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("file").parquet(f"{folder}/rejects"))
    append_table(new, f"{folder}/rows", schema)
