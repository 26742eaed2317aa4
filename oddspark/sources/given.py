"""Views of the given tables in the engine's input shapes.

Orders act as reports (supplier nation = class, supplier = molecule, part name =
reaction), documents act as reports with known answers (language or source =
drug, distinct words = reactions), pages act as product labels, and customers
and events as users, tracked lists and logs. ``FIXTURES.md`` has the mapping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddspark.operators import baskets as B
from oddspark.sources import reports as R
from oddspark.session import shared_folder
from oddspark.sources.stored import StoredTable

#: The scored tables are stored twice, for questions about a drug and about a reaction.
LAYOUTS = {"by_drug": ["drug", "reaction_pt"], "by_reaction": ["reaction_pt", "drug"]}
STOPLIST_SUFFIX = " GIZMO"
DESIGNATED = ["RED BOLT", "HOT ROD", "COLD GEAR", "OLD ANVIL"]
NOUNS = ["ring", "rod", "gear", "bolt", "anvil", "plate", "widget", "gizmo"]
NOUN_CLASSES = {"solid": ["anvil", "plate"], "gadget": ["widget", "gizmo"]}
AS_OF = "2024-01-31"
PREVIOUS_DATE, CURRENT_DATE = "2024-01-30", "2024-01-31"
RECENT = ("2000-01-01", "2000-12-31")
LANGUAGES = ["en", "fr", "de", "es"]
POSITIVE_CONTROLS = [("fr", "LES"), ("de", "UND"), ("es", "EL"), ("es", "DEL")]
NEGATIVE_CONTROLS = [("en", "UND")]


class Given:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def stored(self, name: str, rows: Callable[[], DataFrame], layout: str = "by_drug") -> DataFrame:
        """A table that serving reads: published once a session, then read by every question asked of it.

        The given tables do not change while a session lasts.
        """
        of = hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]
        root = f"{shared_folder(self.spark).rstrip('/')}/stored-{name}-{self.spark.sparkContext.applicationId}-{of}"
        table = StoredTable(self.spark, root, LAYOUTS)
        if table.current() is None:
            table.publish(rows())
        return table.read(layout)

    # --- orders as reports -------------------------------------------------------

    def suppliers(self) -> DataFrame:
        """Supplier with its class (nation) and area (region)."""
        return (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("s_name").alias("molecule"), F.col("n_name").alias("drug"), F.col("r_name").alias("area"))
        )

    def order_lines(self) -> DataFrame:
        """Line items with drug, molecule, area and reaction.

        The dimensions join one by one, each with the size of its own file, so that
        the planner builds on them and never on the line items.
        """
        parts = self.table("part").select("p_partkey", F.col("p_name").alias("reaction_pt"), F.col("p_type").alias("indication"))
        return (
            self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
            .join(self.table("supplier").select("s_suppkey", "s_nationkey", F.col("s_name").alias("molecule")), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_orderkey").alias("report_id"), "molecule", F.col("n_name").alias("drug"), F.col("r_name").alias("area"),
                "reaction_pt", "indication", "l_returnflag",
            )
        )

    def orders(self, level: str = "drug") -> DataFrame:
        """Baskets of order reports at class (``drug``) or ``molecule`` level."""
        return B.from_rows(self.order_lines(), drug_col=level)

    def dated_orders(self, level: str = "drug") -> DataFrame:
        """As ``orders`` plus receipt date, indications and the four outcome flags."""
        carry = {
            "indications": F.collect_set("indication"),
            "disabling": F.bool_or(F.col("l_returnflag") == "R"),
        }
        head = self.table("orders").select(
            F.col("o_orderkey").alias("report_id"),
            F.to_date("o_orderdate").alias("receipt_date"),
            (F.col("o_orderpriority") == "1-URGENT").alias("deaths"),
            (F.col("o_orderpriority") == "2-HIGH").alias("hospitalisations"),
            (F.col("o_orderstatus") == "F").alias("life_threatening"),
        )
        return B.from_rows(self.order_lines(), drug_col=level, carry=carry).join(head, "report_id")

    def nested_reports(self) -> DataFrame:
        """Order reports as nested documents: a line is a drug entry of its supplier's class, its kind of part a reaction."""
        entry = F.struct(
            F.upper("reaction_pt").alias("medicinalproduct"), F.col("indication").alias("drugindication"),
            F.when(F.col("l_returnflag") == "R", R.CONCOMITANT).otherwise(R.SUSPECT).alias("drugcharacterization"),
            F.struct(F.lit(None).cast("string").alias("activesubstancename")).alias("activesubstance"),
            F.struct(*(F.lit(None).cast("array<string>").alias(c) for c in ("generic_name", "brand_name", "substance_name")), F.array("drug").alias("pharm_class_epc")).alias("openfda"),
        )
        reaction = F.struct(F.col("indication").alias("reactionmeddrapt"))
        lines = self.order_lines().groupBy("report_id").agg(F.collect_set(entry).alias("drug"), F.collect_set(reaction).alias("reaction"))
        missing = F.lit(None).cast("string")
        return lines.select(
            F.col("report_id").cast("string").alias("safetyreportid"),
            *(missing.alias(c) for c in R.REPORT.names[1:-2]), F.lit(None).cast(R.REPORT["primarysource"].dataType).alias("primarysource"),
            F.struct(missing.alias("patientsex"), missing.alias("patientonsetage"), "drug", "reaction").alias("patient"),
        )

    def reactions(self) -> DataFrame:
        return self.table("part").select(F.upper("p_name").alias("reaction_pt")).distinct()

    def stoplist(self) -> DataFrame:
        return self.reactions().where(F.col("reaction_pt").endswith(STOPLIST_SUFFIX))

    def designated(self) -> DataFrame:
        return self.reactions().where(F.col("reaction_pt").isin(DESIGNATED))

    def catalogue(self) -> DataFrame:
        """Nested catalogue: one row per class with its area and molecule map."""
        return (
            self.suppliers()
            .groupBy("area", F.col("drug").alias("class"))
            .agg(
                F.map_from_entries(
                    F.collect_list(
                        F.struct("molecule", F.array(F.lower("molecule"), F.lower(F.replace("molecule", F.lit("#"), F.lit(" ")))))
                    )
                ).alias("molecules")
            )
            .select("class", F.col("class").alias("epc"), "area", "molecules")
        )

    def classes(self) -> DataFrame:
        return self.suppliers().select(F.col("drug").alias("class"), F.col("drug").alias("epc"), "area").distinct()

    # --- documents as reports ------------------------------------------------------

    def words(self) -> Column:
        """Distinct upper-cased words of at least two letters."""
        found = F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]{2,})"), 1)
        return F.array_distinct(F.transform(found, F.upper))

    def documents(self, level: str = "lang", until: Column | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
        """Baskets of documents, with the columns to ``carry``; a document is one row already, so nothing is shuffled.

        As a one-row generator the words are a barrier for filters: conditions on them would
        otherwise be pushed down to the text and cut it into words once more each.
        """
        carry = carry or {}
        docs = self.table("documents").select("doc_id", "text", level, *[c.alias(name) for name, c in carry.items()])
        if until is not None:
            docs = docs.where(until)
        return docs.select(
            F.col("doc_id").alias("report_id"), F.array_compact(F.array(level)).alias("drugs"), *carry, F.inline(F.array(F.struct(self.words().alias("reactions"))))
        )

    def first_half(self) -> Column:
        """Documents received by the previous snapshot: ids act as arrival order."""
        top = self.table("documents").agg(F.max("doc_id").alias("m")).select("m").scalar()
        return F.col("doc_id") * 2 <= top

    # --- pages as labels -------------------------------------------------------------

    def label_documents(self) -> DataFrame:
        """One row per page: ``drug, doc_id, sections`` with title boxed and article as harm text."""
        strip = lambda col: F.regexp_replace(col, "<[^>]+>", " ")
        html = F.col("html")
        title = F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1)
        article = strip(F.regexp_extract(html, "(?s)<article>(.*?)</article>", 1))
        nav = strip(F.regexp_extract(html, "(?s)<nav>(.*?)</nav>", 1))
        sections = F.create_map(
            F.lit("boxed_warning"), F.array(title),
            F.lit("adverse_reactions"), F.array(article),
            F.lit("drug_interactions"), F.array(article),
            F.lit("indications_and_usage"), F.array(nav),
        )
        # as a one-row generator the sections are a barrier for filters, which would cut them out of the page once for each name
        return self.table("pages").withColumn("drug", F.regexp_extract("url", "/(en|fr|de|es)/", 1)).where(F.col("drug") != "").select(
            "drug", F.col("page_id").alias("doc_id"), F.inline(F.array(F.struct(sections.alias("sections")))),
        )

    def first_pages(self) -> Column:
        """Label documents that were there at the previous snapshot."""
        top = self.table("pages").agg(F.max("page_id").alias("m")).select("m").scalar()
        return F.col("doc_id") * 2 <= top

    # --- users, tracked lists, logs ----------------------------------------------------

    def users(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"),
            (F.col("c_acctbal") > 0).alias("notify_opt_in"),
            (F.col("c_mktsegment") != "FURNITURE").alias("is_active"),
            (F.pmod("c_custkey", F.lit(5)) != 0).alias("email_verified"),
        )

    def tracked(self) -> DataFrame:
        slot = F.pmod("c_custkey", F.lit(4)).cast("int")
        return self.table("customer").select(
            F.col("c_custkey").alias("user_id"), F.element_at(F.array(*map(F.lit, LANGUAGES)), slot + 1).alias("drug")
        )

    def search_log(self) -> DataFrame:
        matched = F.when(F.col("event_type") != "error", F.col("event_type"))
        return self.table("events").select(
            "event_id", "user_id", F.col("ts").alias("created_at"), F.col("event_type").alias("drug_query"), matched.alias("matched_drug")
        )
