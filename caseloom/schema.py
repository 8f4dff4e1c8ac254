"""Schemas and fixed domain values of the case-log data model."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the application's own values for the
# results to match; they are stated plainly, in their natural order.
# ---------------------------------------------------------------------------

STATUS_IN_PROGRESS = "In progress"
STATUS_COMPLETED = "Completed"

# Resolver tokens that are form placeholders, not people.
PLACEHOLDERS = ["--- Please Select ---", "---", "Please Select", ""]

# Role ENUM in declaration order; sorting uses this ordinal, not the text.
ROLE_ORDER = ["user", "admin", "superadmin"]
VALID_UPDATE_ROLES = ["user", "admin"]
STATUSES = ["In progress", "Completed"]

# Import/export headers, in sheet order, and the column each maps to.
EXPORT_HEADERS = [
    ("case_no", "No."),
    ("case_date", "Date"),
    ("issues", "Issues"),
    ("description", "Description"),
    ("step_to_resolve", "Step to Resolve"),
    ("opened_by", "Opened by"),
    ("department", "Department"),
    ("status", "Status"),
    ("resolved_by", "Resolved by"),
    ("remark", "Remark"),
]

# Import date formats, tried in this order; the first that parses wins.
# Spark datetime patterns equivalent to %Y-%m-%d, %d-%b-%y, %d/%m/%Y,
# %m/%d/%Y, %d-%m-%Y.
IMPORT_DATE_FORMATS = ["yyyy-M-d", "d-MMM-yy", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy"]
# Two-digit years: 69..99 -> 19xx, 00..68 -> 20xx.
TWO_DIGIT_YEAR_PIVOT = 2069

# Declared text widths of the case table (VARCHAR(n)); TEXT columns have none.
CASE_TEXT_LIMITS = {"case_no": 50, "issues": 200, "opened_by": 100, "department": 100, "status": 50,
                    "resolved_by": 200}

EXPORT_DATE_FORMAT = "d-MMM-yy"
DISPLAY_TRUNCATE = 30
EXPORT_WIDTH_CAP = 50
EXPORT_WIDTH_PAD = 2
MAX_FAILED_ATTEMPTS = 3
LOCKOUT_MINUTES = 30
TOP_N = 5
SITE_CODE_MIN_LEN = 3
SITE_CODE_MAX_LEN = 10
DEFAULT_STATUS = STATUS_IN_PROGRESS

# ---------------------------------------------------------------------------
# Table schemas.
# ---------------------------------------------------------------------------

CASE_FIELDS = [c for c, _ in EXPORT_HEADERS]

CASES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("case_no", T.StringType()),
    T.StructField("case_date", T.DateType()),
    T.StructField("issues", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("step_to_resolve", T.StringType()),
    T.StructField("opened_by", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("resolved_by", T.StringType()),
    T.StructField("remark", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("location", T.StringType()),
])

LOCATIONS = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("short_name", T.StringType()),
])

USERS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("eid", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("is_locked", T.BooleanType()),
    T.StructField("locked_until", T.TimestampNTZType()),
    T.StructField("failed_attempts", T.LongType()),
])

# The stored user table: the fields above and the profile of a user.
STORED_USERS = T.StructType(USERS.fields + [
    T.StructField("first_name", T.StringType()),
    T.StructField("last_name", T.StringType()),
    T.StructField("position", T.StringType()),
    T.StructField("phone", T.StringType()),
])

GRANTS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("location_code", T.StringType()),
    T.StructField("can_view", T.BooleanType()),
    T.StructField("can_edit", T.BooleanType()),
    T.StructField("can_delete", T.BooleanType()),
])

ATTEMPTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("ok", T.BooleanType()),
])

TOKENS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("email", T.StringType()),
    T.StructField("otp_code", T.StringType()),
    T.StructField("purpose", T.StringType()),
    T.StructField("expires_at", T.TimestampNTZType()),
    T.StructField("used", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])
