"""Import cleaning (X1, X2, F8, A11): pure column expressions that mark each
row with a reject reason, so accepted and rejected rows and their counts
come from the same single pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.dates import ntz, parse_case_date
from caseloom.functions.text import py_strip
from caseloom.schema import CASE_FIELDS, DEFAULT_STATUS

DATA_FIELDS = ("issues", "description", "opened_by", "department", "case_date")

# reject reasons
NULL_CASE_NO = "null_case_no"    # dropped before counting (empty sheet rows)
EMPTY_CASE_NO = "empty_case_no"  # counted as skipped
NO_DATA = "no_data"              # counted as skipped
TOO_LONG = "too_long"            # optional width check; counted as skipped
SKIPPED = (EMPTY_CASE_NO, NO_DATA, TOO_LONG)


def _filled(c: str) -> Column:
    return F.coalesce(py_strip(F.col(c)) != F.lit(""), F.lit(False))


def reject_reason() -> Column:
    """F8: why a row is not imported (NULL when it is)."""
    case_no = F.col("case_no")
    numeric_zero = F.coalesce(F.expr("try_cast(case_no AS DOUBLE)") == 0, F.lit(False))
    has_data = reduce(lambda a, b: a | b, [_filled(c) for c in DATA_FIELDS])
    given = F.col("case_no_given")
    return (F.when(~given, F.lit(EMPTY_CASE_NO))
             .when(case_no.isNull(), F.lit(NULL_CASE_NO))
             .when((case_no == "") | numeric_zero, F.lit(EMPTY_CASE_NO))
             .when(~has_data, F.lit(NO_DATA)))


def case_no_text(c: str | Column = "case_no") -> Column:
    """A number cell becomes its integer text (``12.0`` -> ``12``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"^(-?[0-9]+)\.[0-9]+$", "$1")


def with_reject_reason(mapped: DataFrame) -> DataFrame:
    """Mark every mapped import row with ``reject_reason``."""
    if "case_no_given" not in mapped.columns:
        mapped = mapped.withColumn("case_no_given", F.lit(True))
    return mapped.withColumn("reject_reason", reject_reason())


def clean_case_rows(mapped: DataFrame, max_lengths: dict[str, int] | None = None) -> DataFrame:
    """Reject reason, date parse (X1), case_no as integer text, status
    default only when the sheet had no Status column (a blank cell stays
    NULL).  Columns beyond the 10 fields (a source row number, the site
    folder) pass through.  ``max_lengths`` (e.g. ``schema.CASE_TEXT_LIMITS``)
    rejects otherwise accepted rows whose text exceeds a declared width,
    where the database would refuse them."""
    marked = with_reject_reason(mapped)
    if max_lengths:
        over = reduce(lambda a, b: a | b,
                      [F.coalesce(F.length(case_no_text(c) if c == "case_no" else F.col(c)) > n, F.lit(False))
                       for c, n in max_lengths.items()])
        marked = marked.withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & over, F.lit(TOO_LONG))
                                                     .otherwise(F.col("reject_reason")))
    status_given = F.col("status_given") if "status_given" in marked.columns else F.lit(True)
    flags = ("reject_reason", "status_given", "case_no_given")
    passthrough = [c for c in marked.columns if c not in CASE_FIELDS and c not in flags]
    return marked.select(
        case_no_text("case_no").alias("case_no"),
        parse_case_date("case_date").alias("case_date"),
        *[F.col(c) for c in CASE_FIELDS if c not in ("case_no", "case_date", "status")],
        F.when(status_given, F.col("status")).otherwise(F.lit(DEFAULT_STATUS)).alias("status"),
        "reject_reason",
        *passthrough,
    ).select(*CASE_FIELDS, "reject_reason", *passthrough)


def accepted(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(cleaned: DataFrame) -> DataFrame:
    return cleaned.filter(F.col("reject_reason").isNotNull())


def import_counts(cleaned: DataFrame) -> DataFrame:
    """One row (inserted, skipped); NULL case_no rows count in neither."""
    r = F.col("reject_reason")
    return cleaned.agg(F.count(F.when(r.isNull(), 1)).alias("inserted"),
                       F.count(F.when(r.isin(*SKIPPED), 1)).alias("skipped"))


def import_reasons(cleaned: DataFrame) -> DataFrame:
    """A11 detail: rows per outcome ('accepted' or the reject reason)."""
    return (cleaned.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))
                   .agg(F.count(F.lit(1)).alias("rows")))


def observed_counts(cleaned: DataFrame, name: str = "import_counts"):
    """A11 without a second pass: attach the counters as an observation to
    the write itself.  Returns (df_to_write, Observation)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    r = F.col("reject_reason")
    df = cleaned.observe(obs, F.count(F.when(r.isNull(), 1)).alias("inserted"),
                         F.count(F.when(r.isin(*SKIPPED), 1)).alias("skipped"))
    return df, obs


def import_into(mapped: DataFrame, site: str, table_path: str, order_col: str = "_row",
                as_of=None) -> dict:
    """S3 -> X2 -> S5: read and clean the mapped sheet once, append the
    accepted rows to ``site`` in the case table and return the counters.
    New ids continue after the table's largest id in sheet order
    (``order_col``); the append is published at once (``sources.versions``)."""
    from caseloom.plans.lineage import cut_lineage
    from caseloom.plans.numbering import global_row_number
    from caseloom.sources.cases import scan_cases
    from caseloom.sources.sinks import append_cases

    # the first import creates the table; a table without rows starts at 0
    base_id = F.coalesce(scan_cases(mapped.sparkSession, table_path).agg(F.max("id")).scalar(), F.lit(0))
    stamp = ntz(as_of) if as_of is not None else F.localtimestamp()
    # the one pass over the sheet counts while it keeps the accepted rows
    cleaned, obs = observed_counts(clean_case_rows(mapped))
    kept = cut_lineage(accepted(cleaned))
    counts = obs.get
    ok = global_row_number(kept, [F.col(order_col)], out_col="_seq")
    rows = ok.select((base_id + F.col("_seq")).cast("long").alias("id"), *CASE_FIELDS,
                     stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(site).alias("location"))
    append_cases(rows, table_path)
    return counts
