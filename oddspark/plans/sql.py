"""SQL fragments the check queries are composed of.

Written against the plain tables and in textbook form (distinct report sets,
joins, the direct recurrence for the special functions), independently of how
the DataFrame jobs are organised.
"""

from __future__ import annotations

from oddspark import constants as K


def psi(x: str) -> str:
    z = f"({x}+10)"
    back = "".join(f" - 1/({x}+{i})" for i in range(10))
    return f"(ln({z}) - 1/(2*{z}) - 1/(12*{z}^2) + 1/(120*{z}^4) - 1/(252*{z}^6) + 1/(240*{z}^8){back})"


def tri(x: str) -> str:
    z = f"({x}+10)"
    back = "".join(f" + 1/(({x}+{i})*({x}+{i}))" for i in range(10))
    return f"(1/{z} + 1/(2*{z}^2) + 1/(6*{z}^3) - 1/(30*{z}^5) + 1/(42*{z}^7) - 1/(30*{z}^9){back})"


def r4(x: str, name: str | None = None) -> str:
    return f"round_even(({x})*10000.0, 0)/10000.0" + (f" AS {name}" if name else "")


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


TIER = (
    f"CASE WHEN a < {K.MIN_REPORTS} THEN 'none' WHEN IC025 > 2 THEN 'strong' WHEN IC025 > 1 THEN 'moderate' "
    "WHEN IC025 > 0 THEN 'weak' ELSE 'none' END"
)

A_LINES = """a_lines AS (
  SELECT l_orderkey AS report_id, s_name AS molecule, n_name AS drug, r_name AS area, upper(p_name) AS reaction_pt,
         p_type AS indication, l_returnflag
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""

A_RD = "a_rd AS (SELECT DISTINCT report_id, drug FROM a_lines)"
A_RM = "a_rm AS (SELECT DISTINCT report_id, molecule AS drug FROM a_lines)"
A_RR = "a_rr AS (SELECT DISTINCT report_id, reaction_pt FROM a_lines)"
A_HEAD = """a_head AS (
  SELECT o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS receipt_date, o_orderpriority = '1-URGENT' AS deaths,
         o_orderpriority = '2-HIGH' AS hospitalisations, o_orderstatus = 'F' AS life_threatening,
         coalesce((SELECT bool_or(l_returnflag = 'R') FROM lineitem WHERE l_orderkey = o_orderkey), false) AS disabling
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""

_WORDS = "list_distinct(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{2,}'), lambda x: upper(replace(x, 'ß', 'ss'))))"


def b_rr(where: str = "true", name: str = "b_rr") -> str:
    return f"{name} AS (SELECT doc_id AS report_id, unnest({_WORDS}) AS reaction_pt FROM documents WHERE {where})"


def b_rd(level: str = "lang", name: str = "b_rd") -> str:
    return f"{name} AS (SELECT DISTINCT doc_id AS report_id, {level} AS drug FROM documents)"


FIRST_HALF = "doc_id * 2 <= (SELECT max(doc_id) FROM documents)"


def cells(p: str, rd: str, rr: str) -> str:
    """``{p}_pairs`` (report, drug, reaction) and ``{p}_t`` with a, b, c, d, N."""
    return f"""{p}_pairs AS (SELECT report_id, drug, reaction_pt FROM {rd} JOIN {rr} USING (report_id)),
{p}_t AS (
  SELECT drug, reaction_pt, a, ab - a AS b, ac - a AS c, N - ab - ac + a AS d, N
  FROM (SELECT drug, reaction_pt, count(*) AS a FROM {p}_pairs GROUP BY ALL)
  JOIN (SELECT drug, count(DISTINCT report_id) AS ab FROM {p}_pairs GROUP BY drug) USING (drug)
  JOIN (SELECT reaction_pt, count(DISTINCT report_id) AS ac FROM {p}_pairs GROUP BY reaction_pt) USING (reaction_pt)
  CROSS JOIN (SELECT count(DISTINCT report_id) AS N FROM {p}_pairs))"""


_D = "CAST({0} AS DOUBLE)"
_DBL = "CAST(a AS DOUBLE) AS xa, CAST(b AS DOUBLE) AS xb, CAST(c AS DOUBLE) AS xc, CAST(d AS DOUBLE) AS xd"


def stats(src: str, out: str, single: bool = False, extra: str = "") -> str:
    """All measures of ``src`` unrounded, plus gate and tier."""
    if single:
        ok = "b > 0 AND c > 0"
        se = "sqrt(1/greatest(xa,1) + 1/xb + 1/xc + 1/greatest(xd,1))"
        prr = "CASE WHEN a+b > 0 AND c+d > 0 AND c > 0 THEN (xa/(xa+xb))/(xc/(xc+xd)) END"
        chi = "CASE WHEN a+b > 0 AND c+d > 0 AND a+c > 0 AND b+d > 0 THEN (xa*xd-xb*xc)*(xa*xd-xb*xc)*(xa+xb+xc+xd)/((xa+xb)*(xc+xd)*(xa+xc)*(xb+xd)) END"
    else:
        ok = "a > 0 AND b > 0 AND c > 0 AND d > 0"
        se = "sqrt(1/xa + 1/xb + 1/xc + 1/xd)"
        prr = f"CASE WHEN {ok} THEN (xa/(xa+xb))/(xc/(xc+xd)) END"
        chi = f"CASE WHEN {ok} THEN (xa*xd-xb*xc)*(xa*xd-xb*xc)*CAST(N AS DOUBLE)/((xa+xb)*(xc+xd)*(xa+xc)*(xb+xd)) END"
    return f"""{out}_1 AS (SELECT *, {_DBL} FROM {src}),
{out}_2 AS (
  SELECT *, CASE WHEN {ok} THEN (xa*xd)/(xb*xc) END AS ROR, CASE WHEN {ok} THEN {se} END AS se, {prr} AS PRR, {chi} AS chi2,
         1+xa AS r1, xa+xb+xc+xd-xa-1 + (2+xa+xb+xc+xd)*(2+xa+xb+xc+xd)/((1+xa+xc)*(1+xa+xb)) AS r2,
         1+xa+xb AS p1, 1+xa+xc AS q1, 2+xa+xb+xc+xd AS m FROM {out}_1),
{out}_3 AS (
  SELECT *, CASE WHEN ROR > 0 THEN exp(ln(ROR) - {K.Z95}*se) END AS ROR_lower, CASE WHEN ROR > 0 THEN exp(ln(ROR) + {K.Z95}*se) END AS ROR_upper,
         CASE WHEN a > 0 THEN ({psi('r1')} - {psi('(r1+r2)')} - {psi('p1')} - {psi('q1')} + 2*{psi('m')})/ln(2) END AS IC,
         {K.Z95}*sqrt(greatest({tri('r1')} - {tri('(r1+r2)')} + {tri('p1')} + {tri('q1')} - 2*{tri('m')}, 0))/ln(2) AS half
  FROM {out}_2),
{out}_4 AS (SELECT * EXCLUDE (se, r1, r2, p1, q1, m, half, xa, xb, xc, xd), IC - half AS IC025, IC + half AS IC975 FROM {out}_3),
{out} AS (SELECT *, coalesce(a >= {K.MIN_REPORTS} AND ROR_lower > 1, false) AS signal, {TIER} AS tier FROM {out}_4)"""


ROUNDED = ", ".join(r4(c, c) for c in ("ROR", "ROR_lower", "ROR_upper", "PRR", "chi2", "IC", "IC025", "IC975"))
SCORED = f"drug, reaction_pt, a, b, c, d, N, {ROUNDED}, signal, tier"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def a_cells(level: str = "drug", p: str = "a") -> str:
    rd = A_RD if level == "drug" else A_RM
    return ",\n".join([A_LINES, rd, A_RR, cells(p, "a_rd" if level == "drug" else "a_rm", "a_rr")])


def b_cells(level: str = "lang", where: str = "true", p: str = "b") -> str:
    return ",\n".join([b_rd(level, f"{p}_rd"), b_rr(where, f"{p}_rr"), cells(p, f"{p}_rd", f"{p}_rr")])


A_SCORED = a_cells() + ",\n" + stats("a_t", "a_s")
B_SCORED = b_cells() + ",\n" + stats("b_t", "b_s")

# Trend of every pair per month.
A_TREND = """a_trend AS (
  SELECT drug, reaction_pt, CAST(date_trunc('month', receipt_date) AS DATE) AS month, count(*) AS n
  FROM a_pairs JOIN a_head USING (report_id) GROUP BY ALL)"""

# Labels: every page is a document of its language.
C_DOCS = r"""c_docs AS (
  SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS drug, page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
         regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]+>', ' ', 'g') AS article
  FROM pages WHERE regexp_extract(url, '/(en|fr|de|es)/', 1) <> '')"""
FIRST_PAGES = "page_id * 2 <= (SELECT max(page_id) FROM pages)"


def norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g')"


def c_labels(where: str = "true", name: str = "c_lab") -> str:
    return f"""{name} AS (
  SELECT drug, page_id, {norm("concat_ws(' ', nullif(title, ''), nullif(article, ''))")} AS text, {norm("title")} AS boxed,
         title <> '' OR article <> '' AS found FROM c_docs WHERE {where})"""


def expected(src: str, label: str, out: str) -> str:
    """``src`` with label_found, labelled, boxed_warning over all documents of the drug.

    What no text of the drug holds, all texts taken together, is settled by that. Terms
    that are one word are settled by it too, unless a boxed section may hold them.
    """
    stop = quoted(K.LABEL_STOPWORDS)
    within = lambda text: f"len(list_filter(toks, lambda t: NOT contains({text}, t))) = 0"
    return f"""{out}_l AS MATERIALIZED (SELECT drug, string_agg(text, '|') AS alltext, string_agg(boxed, '|') AS allboxed FROM {label} WHERE found GROUP BY drug),
{out}_k AS (SELECT drug, bool_or(found) AS label_found FROM {label} GROUP BY drug),
{out}_n AS MATERIALIZED (
  SELECT drug, pt, list_filter(regexp_split_to_array(pt, ' +'), lambda t: length(t) > 3 AND NOT list_contains([{stop}], t)) AS toks
  FROM (SELECT DISTINCT drug, {norm('reaction_pt')} AS pt FROM {src}) WHERE trim(pt) <> ''),
{out}_o AS MATERIALIZED (
  SELECT drug, pt, toks, contains(pt, ' ') OR contains(allboxed, pt) OR (len(toks) > 0 AND {within('allboxed')}) AS open
  FROM {out}_n JOIN {out}_l USING (drug) WHERE contains(alltext, pt) OR (len(toks) > 0 AND {within('alltext')})),
{out}_p AS (SELECT o.drug, pt, toks, l.text, l.boxed, contains(l.text, pt) AS phrase FROM {out}_o o JOIN {label} l ON o.drug = l.drug AND l.found WHERE open),
{out}_q AS (SELECT drug, pt, phrase OR (len(toks) > 0 AND {within('text')}) AS hit,
    boxed <> '' AND CASE WHEN phrase THEN contains(boxed, pt) ELSE len(toks) > 0 AND {within('text')} AND {within('boxed')} END AS boxhit FROM {out}_p),
{out}_r AS (SELECT drug, pt, bool_or(hit) AS hit, bool_or(boxhit) AS boxhit FROM (
    SELECT * FROM {out}_q UNION ALL SELECT drug, pt, true, false FROM {out}_o WHERE NOT contains(pt, ' ')) GROUP BY ALL),
{out} AS (
  SELECT s.*, coalesce(k.label_found, false) AS label_found, CASE WHEN k.label_found THEN coalesce(r.hit, false) END AS labelled,
    CASE WHEN k.label_found THEN coalesce(r.boxhit, false) END AS boxed_warning
  FROM {src} s LEFT JOIN {out}_k k ON s.drug = k.drug LEFT JOIN {out}_r r ON r.drug = s.drug AND r.pt = {norm('s.reaction_pt')})"""


def word_set(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(upper({x}), '[A-Z]+')), lambda w: NOT list_contains([{quoted(K.TRIVIAL_WORDS)}], w))"
