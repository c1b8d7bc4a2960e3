"""Oracle side: the logical tables written once more, in plain SQL, independently of the Spark code.

`expand(body)` prefixes a query body with the views it names (and the views those name).
"""
import re

CX = "((ascii(p_name) + ascii(substr(p_name,2,1))) % 9)"
CY = "((length(p_name)*3 + ascii(right(p_name,1))) % 9)"
PINCODE = f"'5' || lpad((((town_no % 6000)*16 + ({CX}*9+{CY}) % 16)::BIGINT)::VARCHAR, 5, '0')"
NORM_STEPS = [
    (r"\brd\b", "road"), (r"\bst\b", "street"), (r"\bngr\b", "nagar"), (r"\bblk\b", "block"),
    (r"\bh\.?\s?no\.?\b", "house"), (r"\bno\.\b", "number"), (r"\bgal\b", "gali"),
    (r"\bopp\.?\b", "opposite"), (r"\bnr\b", "near"), (r"\bflr\b", "floor"),
    (r"\bsoc\b", "society"), (r"\bapt\b", "apartment"), (r"\bxtn\b", "extension"),
    (r"\bext\b", "extension"),
]


def norm(expr: str) -> str:
    out = f"lower({expr})"
    for pattern, word in NORM_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{word}', 'g')"
    return f"trim(regexp_replace({out}, '[^0-9a-z\\x{{0900}}-\\x{{097F}}\\x{{0C80}}-\\x{{0CFF}}]+', ' ', 'g'))"


def toks(expr: str) -> str:
    return f"regexp_extract_all({expr}, '[0-9A-Za-z\\x{{0C80}}-\\x{{0CFF}}]+')"


def dist(x1, y1, x2, y2) -> str:
    return f"sqrt(({x2}-{x1})*({x2}-{x1}) + ({y2}-{y1})*({y2}-{y1}))"


VIEWS = {
    "w_town": """
SELECT 'T'||n_nationkey AS town_id, n_name AS town_name, r_name AS region_name
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "w_part": """
SELECT p_partkey, p_name, p_type, p_brand, p_partkey % 25 + 25*(p_partkey // 66667) AS town_no
FROM part""",
    "w_locality": f"""
SELECT 'L'||town_no||'-'||replace(p_name,' ','_') AS locality_id, 'T'||town_no AS town_id,
  p_name || CASE WHEN ({CX}*9+{CY}) % 2 = 0 THEN ' nagar' ELSE ' colony' END AS locality_name,
  {PINCODE} AS pincode,
  ((town_no % 50)*20000 + {CX}*400 + 200 + (town_no % 7)*11)::DOUBLE AS cx,
  ((town_no // 50)*20000 + {CY}*400 + 200 + (town_no % 5)*13)::DOUBLE AS cy
FROM w_part GROUP BY town_no, p_name""",
    "w_landmark": """
SELECT 'P'||town_no||'-'||p_type||'-'||p_brand AS poi_id, 'T'||town_no AS town_id,
  p_type AS landmark_type, p_type||' '||p_brand AS poi_name,
  ((town_no % 50)*20000 + (min(p_partkey)//25*131) % 3600)::DOUBLE AS px,
  ((town_no // 50)*20000 + (max(p_partkey)//25*57) % 3600)::DOUBLE AS py
FROM w_part GROUP BY town_no, p_type, p_brand""",
    "w_base": """
SELECT c_custkey AS k, c_mktsegment, c_acctbal, p_name, p_type, p_brand,
  c_nationkey + 25*(c_custkey // 50000) AS town_no
FROM customer LEFT JOIN part ON p_partkey = c_custkey""",
    "w_address": f"""
SELECT k AS address_id, k//2 AS account_id,
  CASE WHEN k % 97 = 96 THEN 'OUT' ELSE 'T'||town_no END AS town_id,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'office' WHEN 'HOUSEHOLD' THEN 'permanent_native'
    ELSE 'current' END AS address_type,
  (DATE '2023-10-01' + (k*7 % 120)::INTEGER)::DATE AS added_date,
  CASE WHEN k % 10 IN (3,4) THEN 'Main Bazaar, ' || p_name ELSE
    CASE WHEN k % 6 = 5 THEN '' ELSE 'H.No ' || (k%40) || ', ' END ||
    CASE WHEN k % 4 = 0 THEN '' ELSE (k%12) || 'th Cross ' END ||
    CASE WHEN k % 8 = 7 THEN 'Post Box' ELSE p_name ||
      CASE k % 3 WHEN 0 THEN ' Ngr' WHEN 1 THEN ' Rd' ELSE '' END END ||
    CASE k % 5 WHEN 0 THEN ' near '||p_type||' '||p_brand WHEN 1 THEN ', opp '||p_type||' '||p_brand
      WHEN 2 THEN ' '||p_type||' '||p_brand||' ಹತ್ತಿರ' ELSE '' END ||
    CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN ' 999999' ELSE ' - ' || {PINCODE} END
  END AS address_text
FROM w_base""",
    "w_point": f"""
SELECT k AS address_id,
  round((town_no % 50)*20000 + {CX}*400 + 200 + coalesce(embedding[1]::DOUBLE*1000, k*37%300-150), 3) AS tx,
  round((town_no // 50)*20000 + {CY}*400 + 200 + coalesce(embedding[2]::DOUBLE*1000, k*91%300-150), 3) AS ty
FROM w_base LEFT JOIN embeddings ON vec_id = k""",
    "w_pin": """
SELECT address_id, round(tx + (address_id*53) % (2*r+1) - r, 3) AS geocoder_x,
  round(ty + (address_id*29) % (2*r+1) - r, 3) AS geocoder_y, precision
FROM (SELECT *, CASE address_id%4 WHEN 0 THEN 10 WHEN 1 THEN 60 WHEN 2 THEN 200 ELSE 600 END AS r,
  CASE address_id%4 WHEN 0 THEN 'rooftop' WHEN 1 THEN 'street' WHEN 2 THEN 'locality'
  ELSE 'pincode' END AS precision FROM w_point WHERE address_id % 13 <> 0)""",
    "w_surveyed": "SELECT address_id, tx AS surveyed_x, ty AS surveyed_y FROM w_point WHERE address_id % 10 = 3",
    "w_split": """
SELECT account_id, CASE WHEN account_id*7%20 < 14 THEN 'train' WHEN account_id*7%20 < 17
  THEN 'validation' ELSE 'test' END AS split
FROM (SELECT DISTINCT c_custkey//2 AS account_id FROM customer)""",
    "w_visit": """
SELECT event_id AS visit_id, user_id AS address_id, user_id//2 AS account_id, 'A'||(k%9) AS agent_id,
  ts - ((k*13 % 1800 - 20) * INTERVAL 1 SECOND) AS start_ts, ts AS observed_at,
  CASE WHEN k%13<>0 THEN (floor(value*7)::BIGINT % 60 + 1)::DOUBLE END AS gps_accuracy_m,
  CASE WHEN k%11<>0 THEN floor(value*20)::BIGINT END AS dwell_s,
  CASE event_type WHEN 'purchase' THEN CASE WHEN k%2=0 THEN 'met_borrower' ELSE 'cash_collected' END
    WHEN 'click' THEN 'met_family' WHEN 'view' THEN 'locked_premises'
    WHEN 'signup' THEN 'neighbour_says_shifted'
    ELSE CASE WHEN k%2=0 THEN 'address_not_traceable' ELSE 'no_such_person' END END AS outcome,
  CASE WHEN k%10=1 THEN 'dup'||k WHEN k%10<>0 THEN 'm'||event_id END AS photo_hash,
  CASE k%6 WHEN 0 THEN 'collected Rs '||format('{:,}', k*150+500) WHEN 1 THEN 'house locked near red plate'
    WHEN 2 THEN 'shifted to other town' WHEN 3 THEN '' WHEN 4 THEN 'ಮನೆ ಮುಚ್ಚಿದೆ'
    ELSE 'met at ECONOMY Brand#1' END AS remark, k
FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events)""",
    "w_trace": """
SELECT l_orderkey AS visit_id, l_linenumber*100000 + l_partkey%100000 AS seq, l_linenumber AS raw_seq,
  l_shipdate + (l_linenumber*37)*INTERVAL 1 SECOND AS point_ts,
  (l_partkey%31-15)::INTEGER AS dx, (l_suppkey*7%31-15)::INTEGER AS dy, l_quantity::INTEGER AS accuracy_m
FROM lineitem""",
    "w_tail": """
SELECT visit_id, quantile_cont(dx,0.5) AS tail_dx, quantile_cont(dy,0.5) AS tail_dy, count(*) AS tail_n
FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY seq DESC, dx, dy) AS rn FROM w_trace)
WHERE rn <= 3 GROUP BY visit_id""",
    "w_tracemed": """
SELECT visit_id, quantile_cont(dx,0.5) AS med_dx, quantile_cont(dy,0.5) AS med_dy, count(*) AS trail_points
FROM w_trace GROUP BY visit_id""",
    "w_checkin": """
SELECT v.*, tx, ty,
  CASE WHEN visit_id%53<>0 THEN round(tx + (visit_id*17%41-20)*0.7::DOUBLE + CASE WHEN visit_id%29=0 THEN 300 ELSE 0 END, 3) END AS checkin_x,
  CASE WHEN visit_id%53<>0 THEN round(ty + (visit_id*23%41-20)*0.7::DOUBLE, 3) END AS checkin_y
FROM w_visit v JOIN (SELECT address_id AS aid, tx AS px, ty AS py FROM w_point) ON aid = address_id,
  LATERAL (SELECT px + CASE WHEN visit_id%83=0 THEN 4000 ELSE 0 END AS tx, py AS ty)""",
    "w_obs": f"""
SELECT visit_id AS observation_id, address_id, account_id, agent_id, 'device-'||agent_id AS device_id, outcome,
  CASE WHEN outcome IN ('no_such_person','address_not_traceable') THEN 'process'
       WHEN outcome IN ('neighbour_says_shifted','locked_premises') THEN 'ambiguous' ELSE 'positive' END AS evidence_class,
  CASE WHEN outcome IN ('no_such_person','address_not_traceable') THEN 'negative'
       WHEN outcome IN ('neighbour_says_shifted','locked_premises') THEN 'ambiguous' ELSE 'positive' END AS polarity,
  CASE WHEN tail_n IS NOT NULL AND checkin_x IS NOT NULL THEN round(tx+tail_dx,3) ELSE checkin_x END AS x,
  CASE WHEN tail_n IS NOT NULL AND checkin_x IS NOT NULL THEN round(ty+tail_dy,3) ELSE checkin_y END AS y,
  CASE WHEN tail_n IS NOT NULL AND checkin_x IS NOT NULL THEN 'trace_tail'||tail_n ELSE 'checkin' END AS coord_method,
  round({dist('checkin_x','checkin_y','(tx+med_dx)','(ty+med_dy)')},3) AS trail_agreement_m,
  gps_accuracy_m, dwell_s, observed_at, photo_hash AS media, remark, checkin_x, checkin_y
FROM w_checkin LEFT JOIN w_tail USING (visit_id) LEFT JOIN w_tracemed USING (visit_id)""",
    "w_account": """
SELECT c_custkey//2 AS account_id, min_by(c_nationkey, c_custkey) AS lender_id, min_by('T'||(c_nationkey + 25*(c_custkey//50000)), c_custkey) AS account_town
FROM customer GROUP BY 1""",
    "w_lender": "SELECT n_nationkey AS lender_id, lower(r_name) AS address_format FROM nation JOIN region ON n_regionkey = r_regionkey",
    "w_agent": """
SELECT 'A'||s_suppkey AS agent_id, CASE WHEN s_suppkey%3<>0 THEN 'field' ELSE 'tele' END AS channel, CASE WHEN s_suppkey%3<>0 THEN 'T'||s_nationkey END AS home_town
FROM supplier WHERE s_suppkey BETWEEN 1 AND 8""",
    "w_xy": """
SELECT vec_id AS id, 'G'||label AS zone, round(embedding[1]::DOUBLE*1000 + (vec_id//4096)*10000, 3) AS x,
  round(embedding[2]::DOUBLE*1000 + (vec_id//4096)*10000, 3) AS y FROM embeddings""",
    "w_link": f"""
SELECT a.zone, a.id AS a, b.id AS b, {dist('a.x','a.y','b.x','b.y')} AS d FROM w_xy a JOIN w_xy b ON a.zone = b.zone AND a.id < b.id
WHERE {dist('a.x','a.y','b.x','b.y')} <= 30 AND {dist('a.x','a.y','b.x','b.y')} > 0""",
    "w_reach": """
SELECT id AS node, id AS comp FROM w_xy UNION
SELECT CASE WHEN a = node THEN b ELSE a END, comp FROM w_reach JOIN w_link ON a = node OR b = node""",
    "w_block": """
SELECT id, zone, x, y, block_id FROM w_xy JOIN (SELECT node AS id, min(comp) AS block_id FROM w_reach GROUP BY 1) USING (id)""",
    "w_fold": """
SELECT block_id, (row_number() OVER (ORDER BY zone, cx, cy, block_id)-1) % 5 AS fold FROM (
 SELECT block_id, zone, round(avg(x),2) AS cx, round(avg(y),2) AS cy FROM w_block GROUP BY 1,2)""",
}


def expand(body: str) -> str:
    """WITH clause holding every view the body needs, in dependency order, then the body."""
    from placeproof.catalog import oracle_domain  # noqa: F401  (adds the domain views)
    order: list[str] = []
    seen: set[str] = set()

    def visit(text: str):
        for name in re.findall(r"\bw_\w+", text):
            if name in VIEWS and name not in seen:
                seen.add(name)
                visit(VIEWS[name])
                order.append(name)

    visit(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS {'' if n == 'w_reach' else 'MATERIALIZED '}({VIEWS[n].strip()})" for n in order)
    head = "WITH RECURSIVE " if "w_reach" in order else "WITH "
    body = body.strip()
    if re.match(r"(?i)with\s", body):
        return f"{head}{ctes},\n" + re.sub(r"(?i)^with\s+(recursive\s+)?", "", body)
    return f"{head}{ctes}\n{body}"
