"""DuckDB SQL of the views in ``driver_tables`` (the correctness oracle).

Each constant is a list of CTE bodies; ``with_views`` assembles a
``WITH ...`` prefix holding only the CTEs a query needs.
"""

from __future__ import annotations

CTES: dict[str, str] = {
    "geo": """SELECT n_nationkey, lower(r_name) AS location
              FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "cust": """SELECT c_custkey, c_name, c_acctbal, c_mktsegment, location
               FROM customer JOIN geo ON c_nationkey = n_nationkey""",
    "first_line": """SELECT l_orderkey, l_partkey AS first_partkey FROM (
                       SELECT l_orderkey, l_partkey,
                              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn
                       FROM lineitem) t WHERE rn = 1""",
    "detail": """SELECT l_orderkey AS d_orderkey, p_name, p_type
                 FROM first_line LEFT JOIN part ON first_partkey = p_partkey""",
    "rnames": """SELECT l_orderkey AS r_orderkey, string_agg(DISTINCT s_name, ', ' ORDER BY s_name) AS names
                 FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) p
                 JOIN supplier ON l_suppkey = s_suppkey
                 GROUP BY l_orderkey""",
    "cases": """SELECT
        o_orderkey AS id,
        CASE WHEN o_orderkey % 7 = 0 THEN 'C-' || CAST(o_orderkey AS VARCHAR)
             ELSE CAST(o_orderkey AS VARCHAR) END AS case_no,
        CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS case_date,
        CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderpriority END AS issues,
        p_name AS description,
        p_type AS step_to_resolve,
        c_name AS opened_by,
        CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '' ELSE c_mktsegment END AS department,
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'In progress' ELSE 'Pending' END AS status,
        CASE WHEN o_orderkey % 29 = 0 THEN '--- Please Select ---' ELSE names END AS resolved_by,
        CAST(NULL AS VARCHAR) AS remark,
        o_orderdate AS created_at,
        o_orderdate AS updated_at,
        location
      FROM orders
      JOIN cust ON o_custkey = c_custkey
      LEFT JOIN detail ON o_orderkey = d_orderkey
      LEFT JOIN rnames ON o_orderkey = r_orderkey""",
    "locations": """SELECT lower(r_name) AS code, r_name AS name, substr(r_name, 1, 3) AS short_name FROM region""",
    "users": """SELECT
        c_custkey AS id,
        c_name AS eid,
        'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
        CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''
             ELSE 'Agent ' || CAST(c_custkey AS VARCHAR) END AS full_name,
        CASE WHEN c_custkey % 20 = 0 THEN 'superadmin' WHEN c_custkey % 20 <= 3 THEN 'admin' ELSE 'user' END AS role,
        c_acctbal < 0 AS is_locked,
        CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-01-15 12:00:00' ELSE NULL END AS locked_until,
        CAST(CASE WHEN c_acctbal < 0 THEN 3 ELSE c_custkey % 3 END AS BIGINT) AS failed_attempts
      FROM customer""",
    "grants": """SELECT user_id, location_code,
             user_id % 7 <> 0 AS can_view, user_id % 2 = 0 AS can_edit, user_id % 3 = 0 AS can_delete
      FROM (SELECT c_custkey AS user_id, location AS location_code FROM cust
            UNION
            SELECT c_custkey AS user_id, lower(r_name) AS location_code
            FROM customer JOIN region ON c_custkey % 5 = r_regionkey) g""",
    "import_raw": """SELECT
        CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN '0'
             WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) || '.0'
             ELSE CAST(o_orderkey AS VARCHAR) END AS "No.",
        CASE WHEN o_orderkey % 11 = 0 THEN NULL
             WHEN o_orderkey % 6 = 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')
             WHEN o_orderkey % 6 = 1 THEN strftime(CAST(o_orderdate AS DATE), '%-d-%b-%y')
             WHEN o_orderkey % 6 = 2 THEN strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y')
             WHEN o_orderkey % 6 = 3 THEN strftime(CAST(o_orderdate AS DATE), '%m/%d/%Y')
             WHEN o_orderkey % 6 = 4 THEN strftime(CAST(o_orderdate AS DATE), '%-d-%-m-%Y')
             ELSE 'garbage' END AS "Date",
        CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS "Issues",
        CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE 'Order ' || CAST(o_orderkey AS VARCHAR) END AS "Description",
        CASE WHEN o_orderkey % 3 = 0 THEN 'Restart' ELSE NULL END AS "Step to Resolve",
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS "Opened by",
        CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE o_orderstatus END AS "Department",
        CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'In progress' ELSE NULL END AS "Status",
        CASE WHEN o_orderkey % 4 = 0 THEN 'a1, b2' ELSE NULL END AS "Resolved by",
        CAST(NULL AS VARCHAR) AS "Remark",
        o_orderkey AS _row
      FROM orders""",
    "attempts": """SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN user_id END AS user_id,
        CASE WHEN event_id % 89 <> 0 THEN ts END AS ts, event_type = 'click' AS ok
      FROM events WHERE event_type IN ('error', 'click')""",
    "tokens": """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS email, CAST(event_id AS VARCHAR) AS otp_code,
             CASE WHEN event_id % 2 = 0 THEN 'register' ELSE 'reset_password' END AS purpose,
             ts + INTERVAL 2 DAY AS expires_at, event_id % 3 = 0 AS used, ts AS created_at
      FROM events""",
    "incoming_users": """SELECT
        c_custkey + (SELECT max(c_custkey) FROM customer) AS id,
        CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'N-' || CAST(c_custkey % 1000 AS VARCHAR) END AS eid,
        CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' new' || CAST(c_custkey AS VARCHAR) || '@example.com ' END AS email,
        ' Ann ' AS first_name,
        'Lee' || CAST(c_custkey AS VARCHAR) AS last_name,
        CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' Agent X' || CAST(c_custkey AS VARCHAR) || ' ' END AS full_name,
        CASE WHEN c_custkey % 10 = 0 THEN 'root' WHEN c_custkey % 10 = 1 THEN 'admin' ELSE NULL END AS role,
        c_custkey % 5 AS region_key,
        CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'Desk ' || CAST(c_custkey % 9 AS VARCHAR) END AS position,
        ' 555-' || CAST(c_custkey AS VARCHAR) || ' ' AS phone
      FROM customer""",
    "incoming_sites": """SELECT ' ' || upper(n_name) || ' ' AS code, n_name AS name,
             CASE WHEN n_nationkey % 7 = 0 THEN ' ' ELSE substr(n_name, 1, 3) END AS short_name,
             CAST(n_nationkey AS BIGINT) AS seq FROM nation
      UNION ALL
      SELECT r_name, r_name, 'R', CAST(r_regionkey + 100 AS BIGINT) FROM region""",
    "grant_requests": """SELECT c_custkey AS user_id, location AS code,
             CASE WHEN c_custkey % 30 = 0 THEN 'boss' ELSE 'admin' END AS role, CAST(1 AS BIGINT) AS seq
      FROM cust WHERE c_custkey % 10 = 0
      UNION ALL SELECT c_custkey, unnest(['asia', 'europe']), NULL, 2 FROM cust WHERE c_custkey % 20 = 0
      UNION ALL SELECT c_custkey, 'africa', 'boss', 3 FROM cust WHERE c_custkey % 40 = 0""",
    "changes": """
      SELECT o_orderkey AS id, 'U-' || CAST(o_orderkey AS VARCHAR) AS case_no, CAST(o_orderdate AS DATE) AS case_date,
             o_orderpriority AS issues, 'changed' AS description, CAST(NULL AS VARCHAR) AS step_to_resolve,
             'ops' AS opened_by, CAST(NULL AS VARCHAR) AS department,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Completed' END AS status, 'a1' AS resolved_by,
             CAST(NULL AS VARCHAR) AS remark, 'U' AS op, CAST(1 AS BIGINT) AS seq FROM orders WHERE o_orderkey % 97 = 0
      UNION ALL
      SELECT o_orderkey, CASE WHEN o_orderkey % 970 = 0 THEN CAST(o_orderkey + (SELECT max(o_orderkey) FROM orders) AS VARCHAR) ELSE 'U-' || CAST(o_orderkey AS VARCHAR) END AS case_no, CAST(o_orderdate AS DATE) AS case_date,
             o_orderpriority AS issues, 'changed twice' AS description, CAST(NULL AS VARCHAR) AS step_to_resolve,
             'ops' AS opened_by, CAST(NULL AS VARCHAR) AS department,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Completed' END AS status, 'a1' AS resolved_by,
             'second' AS remark, 'U', 3 FROM orders WHERE o_orderkey % 194 = 0
      UNION ALL
      SELECT o_orderkey, 'U-' || CAST(o_orderkey AS VARCHAR) AS case_no, CAST(o_orderdate AS DATE) AS case_date,
             o_orderpriority AS issues, 'changed' AS description, CAST(NULL AS VARCHAR) AS step_to_resolve,
             'ops' AS opened_by, CAST(NULL AS VARCHAR) AS department,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Completed' END AS status, 'a1' AS resolved_by,
             CAST(NULL AS VARCHAR) AS remark, 'D', 2 FROM orders WHERE o_orderkey % 101 = 0
      UNION ALL
      SELECT o_orderkey + (SELECT max(o_orderkey) FROM orders) + 1, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey * 7 % (SELECT max(o_orderkey) FROM orders) + (SELECT max(o_orderkey) FROM orders) AS VARCHAR) END AS case_no, CAST(o_orderdate AS DATE) AS case_date,
             o_orderpriority AS issues, 'changed' AS description, CAST(NULL AS VARCHAR) AS step_to_resolve,
             'ops' AS opened_by, CAST(NULL AS VARCHAR) AS department,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Completed' END AS status, 'a1' AS resolved_by,
             CAST(NULL AS VARCHAR) AS remark, 'I', 4
      FROM orders WHERE o_orderkey % 997 = 0
      UNION ALL
      SELECT o_orderkey + (SELECT max(o_orderkey) FROM orders) + 100000, 'U-' || CAST(o_orderkey AS VARCHAR) AS case_no, CAST(o_orderdate AS DATE) AS case_date,
             o_orderpriority AS issues, 'changed' AS description, CAST(NULL AS VARCHAR) AS step_to_resolve,
             'ops' AS opened_by, CAST(NULL AS VARCHAR) AS department,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Completed' END AS status, 'a1' AS resolved_by,
             CAST(NULL AS VARCHAR) AS remark, 'D', 5
      FROM orders WHERE o_orderkey % 991 = 0
      UNION ALL
      SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'R-' || CAST(o_orderkey AS VARCHAR) END AS case_no, CAST(o_orderdate AS DATE) AS case_date,
             o_orderpriority AS issues, 'again' AS description, CAST(NULL AS VARCHAR) AS step_to_resolve,
             'ops' AS opened_by, CAST(NULL AS VARCHAR) AS department,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Completed' END AS status, 'a1' AS resolved_by,
             CAST(NULL AS VARCHAR) AS remark, 'I', 6 FROM orders WHERE o_orderkey % 303 = 0
      UNION ALL
      SELECT o_orderkey + (SELECT max(o_orderkey) FROM orders) + 1, 'U-' || CAST(o_orderkey AS VARCHAR) AS case_no, CAST(o_orderdate AS DATE) AS case_date,
             o_orderpriority AS issues, 'after insert' AS description, CAST(NULL AS VARCHAR) AS step_to_resolve,
             'ops' AS opened_by, CAST(NULL AS VARCHAR) AS department,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Completed' END AS status, 'a1' AS resolved_by,
             CAST(NULL AS VARCHAR) AS remark, 'U', 7 FROM orders WHERE o_orderkey % 1994 = 0""",
    "changes_site": """SELECT c.*, CASE WHEN c.op = 'U' AND c.id % 485 = 0 THEN lower(r_name)
        ELSE coalesce(k.location, lower(r_name)) END AS location
      FROM changes c LEFT JOIN cases k ON c.id = k.id LEFT JOIN region ON c.id % 5 = r_regionkey""",
}

# Which CTEs each CTE reads (so a prefix can be built in dependency order).
DEPS: dict[str, list[str]] = {
    "cust": ["geo"],
    "detail": ["first_line"],
    "cases": ["cust", "detail", "rnames"],
    "grants": ["cust"],
    "grant_requests": ["cust"],
    "changes_site": ["changes", "cases"],
}


def with_views(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` prefix holding ``names`` (and what they read), then ``extra``
    CTEs in the given order; the caller appends the final SELECT."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    parts += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    # a CTE with named columns is a recursive one
    return ("WITH RECURSIVE " if any("(" in n for n in extra or {}) else "WITH ") + ",\n".join(parts) + "\n"
