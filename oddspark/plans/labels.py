"""Label and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddspark import constants as K
from oddspark.functions import display as D
from oddspark.functions import text as X
from oddspark.functions.stats import round_measures
from oddspark.operators import baskets as B
from oddspark.operators import labels as L
from oddspark.operators import outcomes, scoring
from oddspark.plans import bias as PB
from oddspark.plans import sql as q
from oddspark.plans.registry import query
from oddspark.sources.given import Given

_LABELS = q.with_(q.C_DOCS, q.c_labels())


@query("label_harm_text", _LABELS + "SELECT drug, page_id AS doc_id, text, boxed, found FROM c_lab")
def label_harm_text(g: Given):
    return L.harm_text(g.label_documents())


_FLAT = r"""c_flat AS (
  SELECT drug, page_id, trim(regexp_replace(regexp_replace(concat_ws(' ', nullif(article, ''), nullif(title, '')), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text,
         title <> '' OR article <> '' AS found FROM c_docs)"""


@query("label_interaction_text", q.with_(q.C_DOCS, _FLAT) + "SELECT drug, page_id AS doc_id, text, found FROM c_flat")
def label_interaction_text(g: Given):
    return L.interaction_text(g.label_documents())


@query(
    "expectedness",
    q.with_(q.B_SCORED, q.C_DOCS, q.c_labels(), q.expected("b_s", "c_lab", "e"))
    + f"SELECT drug, reaction_pt, a, {q.r4('IC025', 'IC025')}, tier, label_found, labelled, boxed_warning FROM e",
)
def expectedness(g: Given):
    scored = scoring.score(g.documents(), ordered=False, rounded=False)
    out = L.attach_expectedness(scored, L.harm_text(g.label_documents()))
    return round_measures(out.select("drug", "reaction_pt", "a", "IC025", "tier", "label_found", "labelled", "boxed_warning"))


_DICT = r"""dict AS (SELECT DISTINCT drug AS owner, lower(reaction_pt) AS term FROM b_rd JOIN b_rr USING (report_id) WHERE regexp_full_match(reaction_pt, '\p{L}{5,}'))"""


def dictionary(g: Given):
    """The words of five letters or more of each language, one catalogue entry a word."""
    words = B.eligible(g.documents()).select(F.explode("drugs").alias("drug"), F.col("reactions")).select("drug", F.explode("reactions").alias("word"))
    named = words.where(F.col("word").rlike(r"^\p{L}{5,}$")).distinct()
    return named.select("drug", F.array(F.lower("word")).alias("variants"), F.lit(None).cast("string").alias("epc"))


_MENTIONS = (
    q.with_(q.b_rd(), q.b_rr(), _DICT, q.C_DOCS, _FLAT)
    + r""", sent AS (SELECT drug, page_id, unnest(string_split(text, '. ')) AS sentence, generate_subscripts(string_split(text, '. '), 1) AS sno, len(string_split(text, '. ')) AS ns FROM c_flat),
tok AS (SELECT drug, page_id, sno, unnest(regexp_extract_all(sentence, '[\p{L}\p{N}_]+')) AS word, generate_subscripts(regexp_extract_all(sentence, '[\p{L}\p{N}_]+'), 1) AS pos FROM sent),
terms AS (SELECT DISTINCT term FROM dict),
spelt AS (SELECT *, lower(word) AS key FROM tok UNION ALL SELECT *, left(lower(word), -1) FROM tok WHERE lower(word) LIKE '%s'),
hit AS (SELECT drug, page_id, sno, pos, word, term, row_number() OVER (PARTITION BY drug, page_id, sno, pos ORDER BY length(term) DESC) AS rn FROM spelt JOIN terms ON key = term),
own AS (SELECT h.drug AS source, owner AS target, substr(word, 1, length(h.term)) AS term, page_id, sno,
  row_number() OVER (PARTITION BY h.drug, owner ORDER BY length(h.term) DESC, page_id, sno, pos) AS k FROM hit h JOIN dict ON dict.term = h.term WHERE rn = 1 AND owner <> h.drug),
raw AS (SELECT source, target, term, trim(sentence || CASE WHEN own.sno < ns THEN '.' ELSE '' END) AS quote FROM own JOIN sent ON sent.drug = source AND sent.page_id = own.page_id AND sent.sno = own.sno WHERE k = 1),
m AS (SELECT source, target, term, CASE WHEN length(quote) > 400 THEN rtrim(substr(quote, 1, 397)) || '...' ELSE quote END AS quote FROM raw)
"""
)


def mentioned(g: Given):
    return L.mentions(L.interaction_text(g.label_documents()), L.term_index(dictionary(g)))


@query("label_mentions", _MENTIONS + "SELECT source, target, term, quote FROM m")
def label_mentions(g: Given):
    return mentioned(g)


@query(
    "interaction_pairs",
    _MENTIONS + "SELECT least(source, target) AS a, greatest(source, target) AS b, string_agg(source || '>' || target || ':' || term, ',' ORDER BY source, target) AS mentions, count(*) AS directions FROM m GROUP BY ALL",
)
def interaction_pairs(g: Given):
    folded = L.interaction_pairs(mentioned(g))
    text = F.transform("mentions", lambda m: F.concat(m["source"], F.lit(">"), m["target"], F.lit(":"), m["term"]))
    return folded.select("a", "b", F.array_join(text, ",").alias("mentions"), F.size("mentions").cast("long").alias("directions"))


@query("term_list", q.with_(q.b_rd(), q.b_rr(), _DICT) + "SELECT term, owner, length(term) AS letters FROM dict")
def term_list(g: Given):
    return L.term_index(dictionary(g)).withColumn("letters", F.length("term").cast("long"))


@query(
    "coverage_guard",
    q.with_(q.C_DOCS, "att AS (SELECT DISTINCT lang AS drug FROM documents UNION SELECT DISTINCT source FROM documents)")
    + "SELECT count(*) AS attempted, count(l.drug) AS resolved, count(l.drug) / count(*)::DOUBLE AS share, count(l.drug) / count(*)::DOUBLE >= 0.5 AS ok FROM att LEFT JOIN (SELECT DISTINCT drug FROM c_docs) l USING (drug)",
)
def coverage_guard(g: Given):
    docs = g.table("documents")
    attempted = docs.select(F.col("lang").alias("drug")).union(docs.select("source"))
    return L.coverage_guard(L.harm_text(g.label_documents()), attempted)


# --- text functions over whole columns --------------------------------------------

_PAGE_TEXT = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("text_norm", f"SELECT page_id, {_PAGE_TEXT} AS flat, {q.norm('html')} AS normalised, upper(trim(url)) AS address FROM pages")
def text_norm(g: Given):
    return g.table("pages").select(
        "page_id", X.flatten_sections(F.array("html")).alias("flat"), X.norm(F.col("html")).alias("normalised"), F.upper(F.trim("url")).alias("address")
    )


_STOP = q.quoted(K.LABEL_STOPWORDS)


@query(
    "word_overlap",
    f"""SELECT p_partkey, array_to_string(list_sort({q.word_set('p_name')}), ' ') AS words,
      array_to_string(list_filter(regexp_split_to_array({q.norm('p_name')}, ' +'), lambda t: length(t) > 3 AND NOT list_contains([{_STOP}], t)), ' ') AS tokens,
      len(list_intersect({q.word_set('p_name')}, {q.word_set('p_type')})) > 0
        AND len(list_intersect({q.word_set('p_name')}, {q.word_set('p_type')})) >= 0.5 * len({q.word_set('p_name')}) AS overlaps FROM part""",
)
def word_overlap(g: Given):
    words = X.word_set(F.col("p_name"))
    return g.table("part").select(
        "p_partkey", F.array_join(F.sort_array(words), " ").alias("words"), F.array_join(X.label_tokens(X.norm(F.col("p_name"))), " ").alias("tokens"),
        X.shares_words(words, X.word_set(F.col("p_type"))).alias("overlaps"),
    )


@query(
    "quote_sentence",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
    s AS (SELECT doc_id, unnest(string_split(t, '. ')) AS s, generate_subscripts(string_split(t, '. '), 1) AS i, len(string_split(t, '. ')) AS n FROM d),
    k AS (SELECT doc_id, i, trim(s || CASE WHEN i < n THEN '.' ELSE '' END) AS quote FROM s WHERE list_contains(regexp_extract_all(lower(s), '[\p{L}\p{N}_]+'), 'the'))
    SELECT doc_id, CASE WHEN length(quote) > 400 THEN rtrim(substr(quote, 1, 397)) || '...' ELSE quote END AS quote
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM k) WHERE rn = 1""",
)
def quote_sentence(g: Given):
    pieces = X.sentences(X.collapse(F.col("text")))
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    hits = F.filter(pieces, lambda s: F.array_contains(words(s), "the"))
    return g.table("documents").select("doc_id", F.get(hits, F.lit(0)).alias("quote")).where("quote is not null").select("doc_id", X.clip(F.col("quote")).alias("quote"))


@query(
    "display_term",
    r"SELECT p_partkey, upper(p_name) || '^S' AS stored, replace(upper(p_name) || '^S', '^', '''') AS shown, replace(replace(upper(p_name) || '^S', '^', ''), '''', '') AS folded FROM part",
)
def display_term(g: Given):
    stored = F.concat(F.upper("p_name"), F.lit("^S"))
    return g.table("part").select(
        "p_partkey", stored.alias("stored"), X.display_term(stored).alias("shown"), X.reaction_key(X.display_term(stored)).alias("folded")
    )


@query(
    "redact_log",
    r"SELECT page_id, regexp_replace(url || '&api_key=' || page_id || 'secret&x=1', 'api_key=[^&\s]*', 'api_key=[hidden]', 'g') AS line FROM pages",
)
def redact_log(g: Given):
    line = F.concat("url", F.lit("&api_key="), F.col("page_id").cast("string"), F.lit("secret&x=1"))
    return g.table("pages").select("page_id", X.redact(line).alias("line"))


_F2 = lambda x: f"printf('%.2f', round_even(({x})*100.0, 0)/100.0)"
_F1 = lambda x: f"printf('%.1f', round_even(({x})*10.0, 0)/10.0)"
_PCT = lambda x: f"CAST(round_even(({x})*100.0, 0) AS BIGINT) || '%'"
_OUT = {"deaths": "death", "hospitalisations": "hospitalisation", "life_threatening": "life-threatening", "disabling": "disability"}
FORMATTED = f"""CASE WHEN ROR IS NULL THEN '-' WHEN ROR_lower IS NOT NULL AND ROR_upper IS NOT NULL THEN {_F2('ROR')} || ' [' || {_F2('ROR_lower')} || '-' || {_F2('ROR_upper')} || ']' ELSE {_F2('ROR')} END AS ror_text,
  coalesce({_F2('IC025')}, '-') AS ic025_text, {_F2('IC025')} || ' to ' || {_F2('IC975')} AS ic_interval,
  CASE WHEN ROR IS NOT NULL AND active_comparator_ror IS NOT NULL THEN {_F1('ROR')} || ' -> ' || {_F1('active_comparator_ror')} || ' among peers' ||
    CASE WHEN active_comparator_shrinkage > 0 THEN ' (' || {_PCT('active_comparator_shrinkage')} || ' less)' WHEN active_comparator_shrinkage <= 0 THEN ' (peers report it as often)' ELSE '' END END AS comparator_note,
  array_to_string(list_filter([CASE WHEN notoriety_spike THEN 'burst of reports' END, CASE WHEN indication_overlap THEN 'may be the treated condition' END,
    CASE WHEN active_comparator_ror IS NOT NULL AND active_comparator_shrinkage >= 0.9 THEN 'vanishes beside peers' END], lambda v: v IS NOT NULL), '; ') AS flags"""
OUTCOME_TEXT = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {c} > 0 THEN {c} || ' {t}' || CASE WHEN {c} <= a THEN ' (' || {_PCT(f'{c}::DOUBLE / a')} || ')' ELSE '' END END" for c, t in _OUT.items()
) + "], lambda v: v IS NOT NULL), '; ') AS outcomes"
SEVERITY = "sev AS (SELECT drug, reaction_pt, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in K.OUTCOMES) + " FROM a_pairs JOIN a_head USING (report_id) GROUP BY ALL)"


@query(
    "format_profile",
    q.with_(PB.PROFILE_SQL, SEVERITY)
    + f"SELECT drug, reaction_pt, replace(reaction_pt, '^', '''') AS term, a, diagnosed, {FORMATTED}, {OUTCOME_TEXT} FROM prof JOIN sev USING (drug, reaction_pt)",
)
def format_profile(g: Given):
    base = PB.dated(g)
    full = outcomes.attach_severity(PB.profiled(g, base), outcomes.pair_severity(base))
    return D.profile_columns(full).select(
        "drug", "reaction_pt", "term", "a", "diagnosed", "ror_text", "ic025_text", "ic_interval", "comparator_note", "flags", "outcomes"
    )
