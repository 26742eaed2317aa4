"""Configuration files, bulk files and label documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddspark.constants import HARM_SECTIONS, INTERACTION_SECTIONS
from oddspark.functions.text import haystack
from oddspark.operators.baskets import canonical_reaction
from oddspark.operators.facts import original_approval

_S = T.StringType()
_AS = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TARGETS = _struct(
    areas=T.MapType(_S, _struct(label=_S, classes=_AS)),
    classes=T.MapType(_S, _struct(pharm_class_epc=_S, area=_S, molecules=T.MapType(_S, _AS))),
)
_OPENFDA = _struct(generic_name=_AS, brand_name=_AS, substance_name=_AS)
_INGREDIENTS = T.ArrayType(_struct(name=_S))
APPLICATION = _struct(
    application_number=_S,
    products=T.ArrayType(_struct(brand_name=_S, active_ingredients=_INGREDIENTS)),
    openfda=_OPENFDA,
    submissions=T.ArrayType(_struct(submission_type=_S, submission_status=_S, submission_status_date=_S)),
)
DIRECTORY = _struct(product_ndc=_S, generic_name=_S, brand_name=_S, active_ingredients=_INGREDIENTS)
RECALL = _struct(
    recall_number=_S, status=_S, product_description=_S, classification=_S, reason_for_recall=_S, recall_initiation_date=_S, openfda=_OPENFDA
)
SHORTAGE = _struct(status=_S, generic_name=_S, presentation=_S, initial_posting_date=_S, related_info=_S)


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """``reaction_pt`` from a commented one-term-per-line file, upper-cased."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#"))).select(canonical_reaction(F.col("value")).alias("reaction_pt")).distinct()


def targets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TARGETS).option("multiLine", True).json(path)


def catalogue(config: DataFrame) -> DataFrame:
    """``class, epc, area, molecules`` from a targets document."""
    return config.select(F.explode("classes").alias("class", "spec")).select(
        "class", F.col("spec.pharm_class_epc").alias("epc"), F.col("spec.area").alias("area"), F.col("spec.molecules").alias("molecules")
    )


def area_members(config: DataFrame) -> DataFrame:
    return config.select(F.explode("areas").alias("area", "spec")).select("area", F.explode("spec.classes").alias("epc"))


def molecules(catalogue_rows: DataFrame) -> DataFrame:
    return catalogue_rows.select("class", "epc", F.explode("molecules").alias("molecule", "variants"))


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """``epc, phrases``; keys starting with an underscore are notes."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", T.MapType(_S, _S))).alias("epc", "raw"))
    return entries.where(~F.startswith("epc", F.lit("_"))).select("epc", F.from_json("raw", _AS).alias("phrases"))


def bulk(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """Records of a bulk document (``results`` array), with their position as ``seq``."""
    schema = T.StructType([T.StructField("results", T.ArrayType(record))])
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    return docs.select(F.posexplode("results").alias("seq", "r")).select("seq", "r.*")


def _names(prefix: str = "openfda") -> list:
    return [F.array_join(f"{prefix}.{c}", " | ") for c in ("generic_name", "substance_name", "brand_name")]


def application_records(raw: DataFrame) -> DataFrame:
    ingredients = F.array_join(F.flatten(F.transform("products", lambda p: F.transform(p["active_ingredients"], lambda i: i["name"]))), " | ")
    brands = F.array_join(F.transform("products", lambda p: p["brand_name"]), " | ")
    return raw.select(
        F.col("application_number").alias("record_id"), haystack(ingredients, brands, *_names()).alias("haystack"),
        original_approval(F.col("submissions")).alias("approval"),
    )


def directory_records(raw: DataFrame) -> DataFrame:
    ingredients = F.array_join(F.transform("active_ingredients", lambda i: i["name"]), " | ")
    return raw.select(F.col("product_ndc").alias("record_id"), haystack(F.col("generic_name"), F.col("brand_name"), ingredients).alias("haystack"))


def recall_records(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("recall_number").alias("record_id"), "status", "classification", F.col("reason_for_recall").alias("reason"),
        F.col("recall_initiation_date").alias("initiated"), haystack(F.col("product_description"), *_names()).alias("haystack"),
    )


def shortage_records(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("seq").alias("record_id"), "status", "seq", F.col("initial_posting_date").alias("since"),
        haystack(F.col("generic_name"), F.col("presentation")).alias("haystack"),
    )


def label_documents(raw: DataFrame, drug: str = "drug", doc: str = "doc_id") -> DataFrame:
    """Label documents with one column per section (string arrays) to a section map."""
    wanted = [s for s in dict.fromkeys(HARM_SECTIONS + INTERACTION_SECTIONS) if s in raw.columns]
    pairs = [x for s in wanted for x in (F.lit(s), F.col(s))]
    return raw.select(F.col(drug).alias("drug"), F.col(doc).alias("doc_id"), F.create_map(*pairs).alias("sections"))
