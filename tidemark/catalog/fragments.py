"""SQL text shared by the oracle statements: the same inputs as ``bindings`` derives."""

COMPANIES = """companies AS (
  SELECT s_suppkey AS company_id, s_name AS company, r_name AS sector, n_name AS industry,
         CASE WHEN s_acctbal >= 7000 THEN 'large' WHEN s_acctbal >= 3000 THEN 'mid' ELSE 'small' END AS mcap_band
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

WIDE = """wide AS (
  SELECT l_suppkey AS company_id, CAST(year(l_shipdate) AS INTEGER) AS fy,
         sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS revenue,
         sum(CAST(l_discount AS DECIMAL(18,2))) AS discount, sum(CAST(l_tax AS DECIMAL(18,2))) AS tax,
         sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS rev_a,
         sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS rev_n,
         sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS rev_r
  FROM lineitem GROUP BY 1, 2)"""

FACTS = (
    WIDE
    + """, facts AS (
  SELECT company_id, fy, metric_key, CAST(value AS DECIMAL(24,6)) AS value,
         sha256(concat_ws('/', 'pin', company_id, fy, metric_key)) AS pin_id
  FROM ("""
    + " UNION ALL ".join(
        f"SELECT company_id, fy, '{key}' AS metric_key, {key} AS value FROM wide"
        for key in ("qty", "revenue", "discount", "tax", "rev_a", "rev_n", "rev_r")
    )
    + ") u WHERE value IS NOT NULL)"
)

STAR = COMPANIES + ", " + FACTS

CANDIDATES = STAR + ", cand AS (SELECT f.*, c.sector FROM facts f JOIN companies c USING (company_id))"

BROKEN = (
    STAR
    + """, cand AS (
  SELECT f.company_id, f.fy, f.metric_key, c.sector, f.pin_id,
         CASE WHEN metric_key = 'revenue' AND f.company_id % 7 = 3 THEN value * 10
              WHEN metric_key = 'discount' AND f.company_id % 11 = 5 THEN -value
              ELSE value END AS value
  FROM facts f JOIN companies c USING (company_id))"""
)

SCORES = """counted AS (
  SELECT l_suppkey AS company_id, CAST(year(l_shipdate) AS INTEGER) AS fy, count(*) AS n,
         count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_returnflag = 'A') AS a,
         count(*) FILTER (WHERE l_returnflag = 'R') AS r
  FROM lineitem GROUP BY 1, 2),
scores AS (
  SELECT company_id, fy, score_key, method_version,
         CAST(round_even(100.0::DOUBLE * top / bottom, 4) AS DECIMAL(10,4)) AS value,
         sha256(concat_ws('/', 'pin', company_id, fy, score_key)) AS pin_id
  FROM (SELECT company_id, fy, 'completeness' AS score_key, 'v1' AS method_version, f AS top, n AS bottom FROM counted
        UNION ALL SELECT company_id, fy, 'completeness', 'v2', f * 2 + a, n * 3 FROM counted
        UNION ALL SELECT company_id, fy, 'substance', 'v1', a, n FROM counted
        UNION ALL SELECT company_id, fy, 'substance', 'v2', a + r, n * 2 FROM counted
        UNION ALL SELECT company_id, fy, 'assurance_readiness', 'v1', r, n FROM counted
        UNION ALL SELECT company_id, fy, 'assurance_readiness', 'v2', r * 3 + f, n * 4 FROM counted) s)"""

FILINGS = """filings AS (
  SELECT o_orderkey AS filing_id, o_custkey AS company_id, CAST(year(o_orderdate) AS INTEGER) AS fy,
         CASE o_orderstatus WHEN 'F' THEN 'fetched' WHEN 'O' THEN 'parsed' ELSE 'missing' END AS status,
         o_orderdate AS submitted
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate)
                                         ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""

ISSUERS = """issuers AS (
  SELECT c_custkey AS company_id, c_name AS company, c_mktsegment AS sector,
         CASE WHEN c_acctbal >= 7000 THEN 'large' WHEN c_acctbal >= 3000 THEN 'mid' ELSE 'small' END AS mcap_band
  FROM customer)"""

VERSIONS = """versions AS (
  SELECT o_orderkey AS field_id, o_custkey AS filing_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'p1.e1.urgent' WHEN '2-HIGH' THEN 'p1.e2.high'
              WHEN '3-MEDIUM' THEN 'p2.e1.medium' WHEN '4-NOT SPECIFIED' THEN 'p2.e2.not_specified'
              WHEN '5-LOW' THEN 'a.basics.low' END AS field_key,
         o_orderkey + 1 AS version,
         CASE o_orderstatus WHEN 'F' THEN 'sampled_ok' WHEN 'P' THEN 'corrected' ELSE 'unreviewed' END AS qa_status,
         CAST(((o_orderkey * 37) % 101) / 100.0 AS DECIMAL(5,4)) AS confidence,
         CASE WHEN o_orderkey % 3 = 0 THEN 'xbrl' ELSE 'llm' END AS method,
         CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderkey % 50 + 1 AS INTEGER) END AS source_page,
         CAST(o_totalprice AS DECIMAL(18,2)) AS value_num, o_orderdate AS created_at
  FROM orders)"""

CLOSINGS = (
    " We target a 20% cut by FY 2030 under ISO 14001.",
    " The policy and code of conduct help to reduce 15 kl of water.",
    " Training and safety of every employee and worker before 2027.",
    " Electricity in kWh and gigajoule follows the GHG Protocol methodology.",
    " Environment and ESG report, CSR and BRSR filing until FY2026.",
    "",
)

NARRATIVES = (
    "narr AS (SELECT doc_id, source AS company, text || CASE doc_id % 6 "
    + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLOSINGS))
    + " END AS text, lang, n_chars FROM documents)"
)

SHINGLES = (
    NARRATIVES
    + """, w AS (SELECT doc_id, company, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM narr),
sh AS (SELECT doc_id, company, array_to_string(w[i:i+7], ' ') AS phrase FROM w, unnest(range(1, len(w) - 6)) AS r(i))"""
)


def hash_vectors_sql(name: str, source: str, doc: str, text: str, dimensions: int) -> str:
    return f"""{name}_t AS (SELECT {doc}, sha256(token) AS h FROM {source}, unnest(regexp_split_to_array(lower({text}), '\\s+')) AS x(token) WHERE token <> ''),
{name}_w AS (SELECT {doc}, CAST(('0x' || substr(h, 1, 8))::UBIGINT % {dimensions} AS INTEGER) AS index,
  sum(CASE WHEN ('0x' || substr(h, 9, 2))::UBIGINT % 2 = 1 THEN -1 ELSE 1 END) AS weight FROM {name}_t GROUP BY 1, 2),
{name} AS (SELECT *, sum(weight * weight) OVER (PARTITION BY {doc}) AS norm2 FROM {name}_w WHERE weight <> 0)"""
