"""Product-fact queries: orders as applications, parts as directory, lines as recalls."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddspark.operators import facts as X
from oddspark.operators import scoring
from oddspark.plans import sql as q
from oddspark.plans.registry import query
from oddspark.sources import given as G
from oddspark.sources import reports as R
from oddspark.sources.given import Given
from oddspark.sources.sinks import publish

def _hay():
    return F.lower("p_name")



def molecules(g: Given):
    nouns = [(n, [n, f"{n}s"]) for n in G.NOUNS]
    return g.spark.createDataFrame(nouns, "molecule string, variants array<string>")


def members(g: Given):
    return g.spark.createDataFrame([(c, m) for c, ms in G.NOUN_CLASSES.items() for m in ms], "class string, molecule string")


def _lines(g: Given):
    return g.table("lineitem").join(g.table("part"), F.col("l_partkey") == F.col("p_partkey"))


def applications(g: Given):
    """One application per order: its part names, one submission."""
    named = _lines(g).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set(_hay())), " | ").alias("haystack"))
    submission = F.struct(
        F.when(F.col("o_orderstatus") == "O", "ORIG").otherwise("SUPPL").alias("submission_type"),
        F.when(F.col("o_orderpriority") == "5-LOW", "TA").otherwise("AP").alias("submission_status"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("submission_status_date"),
    )
    return named.join(g.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("record_id"), "haystack", X.original_approval(F.array(submission)).alias("approval")
    )


def directory(g: Given):
    return g.table("part").where("p_size <= 45").select(F.col("p_partkey").alias("record_id"), _hay().alias("haystack"))


def recall_records(g: Given):
    group = F.pmod("l_linenumber", F.lit(3))
    return _lines(g).where("l_returnflag = 'R'").select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("record_id"), _hay().alias("haystack"),
        F.when(F.col("l_linestatus") == "O", "Ongoing").otherwise("Terminated").alias("status"),
        F.when(group == 0, "Class I").when(group == 1, "Class II").otherwise("Class III").alias("classification"),
        F.lit("").alias("reason"), F.date_format("l_shipdate", "yyyyMMdd").alias("initiated"),
    )


def shortage_records(g: Given):
    state = F.when(F.col("p_type") == "PROMO", "Current").when(F.col("p_type") == "ECONOMY", "To Be Discontinued").otherwise("Resolved")
    return g.table("part").select(
        F.col("p_partkey").alias("record_id"), _hay().alias("haystack"), state.alias("status"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("since")
    )


_FORMS = "forms AS (SELECT n AS molecule, unnest([n, n || 's']) AS form FROM (SELECT unnest([" + q.quoted(G.NOUNS) + "]) AS n)), f AS (SELECT * FROM forms WHERE length(form) >= 5)"
_MATCH = r"regexp_matches({0}, '\b' || form || '\b')"


@query("facts_match", q.with_(_FORMS) + f"SELECT DISTINCT p_partkey AS record_id, molecule FROM part JOIN f ON {_MATCH.format('lower(p_name)')}")
def facts_match(g: Given):
    records = g.table("part").select(F.col("p_partkey").alias("record_id"), _hay().alias("haystack"))
    return X.facts_match(records, X.molecule_forms(molecules(g)))


def _entry_sql(where: str) -> str:
    """Classes and molecules of the entries of every report, and kinds of part as its reactions."""
    return f"""n_in AS (SELECT * FROM a_lines WHERE {where}),
n_rd AS (SELECT DISTINCT report_id, drug FROM n_in UNION SELECT DISTINCT report_id, f.molecule FROM n_in JOIN f ON {_MATCH.format('lower(reaction_pt)')}),
n_rr AS (SELECT DISTINCT report_id, upper(trim(indication)) AS reaction_pt FROM a_lines)"""


def _scored_sql(where: str) -> str:
    return q.with_(_FORMS, q.A_LINES, _entry_sql(where), q.cells("n", "n_rd", "n_rr"), q.stats("n_t", "n_s")) + f"SELECT {q.SCORED} FROM n_s"


def _both_levels(g: Given, roles: list[str] | None = None):
    nested = publish(g.nested_reports(), "nested_reports")  # classes and names are read from it apart
    baskets = R.class_baskets(nested, roles).select("report_id", "drugs", "reactions")
    return scoring.score(X.molecule_baskets(baskets, R.report_drug(nested, roles), X.molecule_forms(molecules(g))), ordered=False)


@query("score_molecules", _scored_sql("true"))
def score_molecules(g: Given):
    return _both_levels(g)


@query("score_suspects", _scored_sql("l_returnflag <> 'R'"))
def score_suspects(g: Given):
    return _both_levels(g, [R.SUSPECT])


_FACTS = q.with_(
    _FORMS,
    f"""pm AS (SELECT DISTINCT p_partkey, molecule FROM part JOIN f ON {_MATCH.format('lower(p_name)')}),
app AS (SELECT DISTINCT l_orderkey, molecule, o_orderdate FROM lineitem JOIN pm ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW'),
appr AS (SELECT molecule, CAST(min(o_orderdate) AS DATE) AS first_approval, count(*) AS applications FROM app GROUP BY molecule),
mk AS (SELECT molecule, count(*) AS listed_products FROM pm JOIN part USING (p_partkey) WHERE p_size <= 45 GROUP BY molecule),
rc AS (SELECT molecule, l_orderkey * 100 + l_linenumber AS rid, CASE l_linenumber % 3 WHEN 0 THEN 'Class I' WHEN 1 THEN 'Class II' ELSE 'Class III' END AS cl, strftime(l_shipdate, '%Y%m%d') AS d
  FROM lineitem JOIN pm ON p_partkey = l_partkey WHERE l_returnflag = 'R' AND l_linestatus = 'O'),
rr AS (SELECT molecule, count(*) AS recalls_open, count(*) FILTER (cl = 'Class I') AS recalls_class_i FROM rc GROUP BY molecule),
rl AS (SELECT molecule, d, cl FROM (SELECT *, row_number() OVER (PARTITION BY molecule ORDER BY d DESC, cl DESC, rid DESC) AS rn FROM rc) WHERE rn = 1),
sh AS (SELECT molecule, st, p_brand FROM (SELECT molecule, p_brand, CASE p_type WHEN 'PROMO' THEN 'Current' ELSE 'To Be Discontinued' END AS st,
  row_number() OVER (PARTITION BY molecule ORDER BY p_type = 'PROMO' DESC, CASE WHEN p_type = 'PROMO' THEN p_partkey ELSE -p_partkey END) AS rn FROM pm JOIN part USING (p_partkey) WHERE p_type IN ('PROMO', 'ECONOMY')) WHERE rn = 1),
fx AS (SELECT n.molecule AS drug, first_approval, applications::DOUBLE AS applications, coalesce(listed_products, 0)::DOUBLE AS listed_products, coalesce(listed_products, 0) > 0 AS marketed_now,
  coalesce(recalls_open, 0)::DOUBLE AS recalls_open, coalesce(recalls_class_i, 0)::DOUBLE AS recalls_class_i, d AS recall_latest, cl AS recall_latest_class, st AS shortage_status, p_brand AS shortage_since, false AS from_class_members
  FROM (SELECT DISTINCT molecule FROM forms) n LEFT JOIN appr USING (molecule) LEFT JOIN mk USING (molecule) LEFT JOIN rr USING (molecule) LEFT JOIN rl USING (molecule) LEFT JOIN sh USING (molecule)
  UNION ALL SELECT class, min(first_approval), sum(applications)::DOUBLE, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true FROM appr JOIN (
    SELECT unnest(['solid', 'solid', 'gadget', 'gadget']) AS class, unnest(['anvil', 'plate', 'widget', 'gizmo']) AS molecule) USING (molecule) GROUP BY class)""",
)


def facts(g: Given):
    return X.drug_facts(molecules(g), members(g), applications(g), directory(g), recall_records(g), shortage_records(g), G.AS_OF)


@query("drug_facts", _FACTS + f"SELECT *, round_even(date_diff('day', first_approval, DATE '{G.AS_OF}') / 365.25 * 10, 0) / 10 AS years_marketed FROM fx")
def drug_facts(g: Given):
    counts = ["applications", "listed_products", "recalls_open", "recalls_class_i"]
    return facts(g).withColumns({c: F.col(c).cast("double") for c in counts})


_KNOWN = [("anvil", 1995, True), ("plate", 1996, True), ("widget", 2000, None), ("ring", None, False), ("gizmo", None, True), ("bolt", 1995, None)]


@query(
    "controls_facts",
    _FACTS
    + ", kn AS (SELECT * FROM (VALUES " + ", ".join(f"('{d}', {'NULL' if y is None else y}, CAST({'NULL' if m is None else m} AS BOOLEAN))" for d, y, m in _KNOWN) + ") t(drug, y, m))"
    + " SELECT kn.drug, y::DOUBLE AS year, year(first_approval)::DOUBLE AS got_year, m AS marketed, marketed_now, (y IS NULL OR coalesce(abs(year(first_approval) - y) <= 1, false)) AND (m IS NULL OR coalesce(marketed_now = m, false)) AS passed FROM kn LEFT JOIN fx USING (drug)",
)
def controls_facts(g: Given):
    known = g.spark.createDataFrame(_KNOWN, "drug string, year int, marketed boolean")
    out = X.check_known(facts(g), known)
    return out.withColumns({c: F.col(c).cast("double") for c in ("year", "got_year")})
