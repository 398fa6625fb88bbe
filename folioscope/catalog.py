"""Registered queries over the driver's tables and their SQL counterparts.

All queries read whole tables.  Those whose results rest on ``difflib`` have no SQL; tests
hold them against plain Python over whole tables.
"""

from __future__ import annotations

import itertools
import uuid

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.config import LayoutConfig
from folioscope.functions import similarity as S
from folioscope.functions import text as T
from folioscope.operators import classify, diffing, layout, matching, report, sections
from folioscope.plans import compare, corpus
from folioscope.sources import pdf, readers, sheets, writers
from folioscope.sources.files import write_files
from folioscope.storage import shared_dir, size_of, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Stored bytes of documents whose spans one task sorts.
SPAN_BYTES = 8 << 20
#: A footer, and forms of it with one character misread.
_CLEAN, _NOISY = "corpus review footer", ("co#pus review footer", "corpus r#view footer", "corpus review foot#r")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL building blocks (DuckDB) ------------------------------------------------------


def _collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _toc(c: str) -> str:
    return (
        rf"(CASE WHEN regexp_matches({c}, '^(.+?)\s*[.…·]{{3,}}\s*(\d{{1,4}})\s*$') THEN trim(regexp_extract({c}, '^(.+?)\s*[.…·]{{3,}}\s*(\d{{1,4}})\s*$', 1))"
        rf" WHEN regexp_matches({c}, '^(.+?)\s+(\d{{1,4}})\s*$') AND len(string_split(regexp_extract({c}, '^(.+?)\s+(\d{{1,4}})\s*$', 1), ' ')) >= 4"
        rf" AND regexp_matches({c}, '(?i)^([ivxlcdm]+\.\s+|(chapter|section|part|annex)([^\p{{L}}\p{{N}}_]|$))') THEN trim(regexp_extract({c}, '^(.+?)\s+(\d{{1,4}})\s*$', 1)) ELSE {c} END)"
    )


def _norm(c: str) -> str:
    return _collapse(rf"regexp_replace(lower({_toc(c)}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


_TEXT = "coalesce(text, '')"

_RAW = rf"""raw AS (SELECT doc_id, source, unnest(range(len(x))) AS line_no, unnest(x) AS raw FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
body0 AS (SELECT doc_id, source, line_no, CASE WHEN line_no % 5 = (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END) THEN 'Principle ' || (line_no // 5 + 1) || ': ' || left(t, 40)
  WHEN (doc_id + line_no) % 17 = 0 THEN 'IV. ' || left(t, 30) WHEN (doc_id + line_no) % 13 = 0 THEN 'b. ' || left(t, 30) WHEN (doc_id + line_no) % 11 = 0 THEN '3. ' || left(t, 30)
  WHEN (doc_id + line_no) % 19 = 0 THEN 'References' ELSE t END AS text FROM (SELECT *, {_collapse('raw')} AS t FROM raw)),
body_a AS (SELECT doc_id, source, line_no, text || CASE WHEN (doc_id + line_no) % 7 = 0 THEN '{corpus.EDIT_A}' ELSE '' END AS text FROM body0),
body_b AS (SELECT doc_id, source, line_no, CASE WHEN doc_id % 2 = 0 AND text LIKE 'IV. %' THEN 'V. ' || substr(text, 5) ELSE text END AS text
  FROM (SELECT doc_id, source, line_no, text || CASE WHEN (doc_id + line_no) % 7 = 0 THEN '{corpus.EDIT_B}' ELSE '' END AS text FROM body0 WHERE (doc_id + line_no) % 23 <> 0))"""


def _lines(v: str) -> str:
    return (
        f"pages_{v} AS (SELECT doc_id, line_no // 4 + 1 AS page, max(source) AS source FROM body_{v} GROUP BY 1, 2),\n"
        f"lines_{v} AS (SELECT doc_id, (line_no // 4 + 1) * 10 + 1 + line_no % 4 AS line_no, line_no // 4 + 1 AS page, 100.0 + 40 * (line_no % 4) AS y0, 120.0 + 40 * (line_no % 4) AS y1, text FROM body_{v}\n"
        f" UNION ALL SELECT doc_id, page * 10, page, 20.0, 40.0, page::VARCHAR FROM pages_{v} UNION ALL SELECT doc_id, page * 10 + 9, page, 760.0, 780.0, 'Corpus review ' || coalesce(source, '') || ' page ' || page FROM pages_{v})"
    )


def _sections(v: str) -> str:
    t = "text"
    return (
        rf"""lab_{v} AS (SELECT doc_id, line_no, text, CASE WHEN regexp_matches({t}, '^.+?[.…·]{{3,}}\s*\d{{1,4}}\s*$') THEN 'reference_line' WHEN regexp_matches({t}, '^(\[\d+\]|\d+\)|\d+)\s*$') THEN 'footnote_label'
 WHEN regexp_matches({t}, '(?i)^(references?|source|bibliography|annex|appendix)([^\p{{L}}\p{{N}}_]|$)') THEN 'reference_line' WHEN regexp_matches({t}, '^[IVXLCDM]+\.\s+.+') THEN 'major_heading'
 WHEN regexp_matches({t}, '(?i)^(principle|article|section|chapter|standard|rule)\s+(\d+[a-z]?)\s*[:.-]?\s*(.*)$') THEN 'named_numbered_heading' WHEN regexp_matches({t}, '^\d+\.\s+.+') THEN 'numeric_heading'
 WHEN regexp_matches({t}, '^[A-Za-z]\.\s+.+') THEN 'letter_heading' ELSE 'body' END AS label FROM (SELECT doc_id, line_no, {_collapse('text')} AS text FROM body_{v}) WHERE text <> ''),
lev_{v} AS (SELECT *, sum(CASE WHEN level IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS ordinal FROM
 (SELECT *, CASE WHEN label IN ('major_heading', 'named_numbered_heading') THEN 1 WHEN label = 'letter_heading' THEN 2 END AS level FROM lab_{v})),
sec_{v} AS (SELECT doc_id, ordinal, max(level) AS level, max(CASE WHEN level IS NOT NULL THEN label END) AS label, max(CASE WHEN level IS NOT NULL THEN text END) AS title,
 coalesce(list(text ORDER BY line_no) FILTER (level IS NULL), []) AS body, count(*) FILTER (level IS NULL AND label = 'numeric_heading') AS n_children FROM lev_{v} WHERE ordinal > 0 OR label <> 'reference_line' GROUP BY doc_id, ordinal)"""
    )


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join((_RAW, *parts)) + "\n"


# --- plans shared by queries -----------------------------------------------------------


def _body(spark, sf_dir, v="a"):
    return corpus.positioned(corpus.version(corpus.body_lines(corpus.documents(spark, sf_dir)), v))


def _cut(spark, sf_dir, v="a"):
    return sections.sections(_body(spark, sf_dir, v))


def _keyed(spark, sf_dir):
    """Sections of both versions side by side, by ordinal: what fuzzy matching is not needed for."""
    side = lambda v: _cut(spark, sf_dir, v).select(F.col("doc_id").alias("pair_id"), F.col("ordinal").alias("diff_no"), *[F.col(c).alias(f"{c}_{v}") for c in ("section_id", "title", "body", "body_lines", "level", "start_page")])
    return side("a").join(side("b"), ["pair_id", "diff_no"])


# --- lines and sections ----------------------------------------------------------------


@query(_with(_sections("a")) + "SELECT label, count(*) AS n FROM lab_a GROUP BY label")
def line_labels(spark, sf_dir):
    return sections.labelled(_body(spark, sf_dir)).filter("text <> ''").groupBy("label").agg(F.count("*").alias("n"))


@query(_with(_sections("a")) + "SELECT doc_id, ordinal::BIGINT AS ordinal, len(body)::BIGINT AS n_body, n_children FROM sec_a")
def section_sizes(spark, sf_dir):
    rows = sections.leveled(_body(spark, sf_dir))
    body = F.col("level").isNull()
    return rows.groupBy("doc_id", "ordinal").agg(F.count_if(body).alias("n_body"), F.count_if(body & (F.col("label") == "numeric_heading")).alias("n_children"))


ENTRY = section_sizes


@query(_with(_sections("a")) + f"SELECT doc_id, ordinal::BIGINT AS ordinal, {_norm('title')} AS title_normalized FROM sec_a WHERE ordinal > 0")
def normalized_titles(spark, sf_dir):
    heads = sections.leveled(_body(spark, sf_dir)).filter("level is not null")
    return heads.select("doc_id", "ordinal", T.normalize_title(F.col("text")).alias("title_normalized"))


@query(
    _with(_sections("a"))
    + rf"""SELECT doc_id, ordinal::BIGINT AS ordinal, CASE WHEN ordinal = 0 THEN 'preamble' ELSE 's' || lpad((ordinal + max(CASE WHEN ordinal = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id))::BIGINT::VARCHAR, 4, '0') || '-' ||
 left(coalesce(nullif(trim(regexp_replace(replace({_norm(_toc('title'))}, ' ', '-'), '-+', '-', 'g'), '-'), ''), 'untitled'), 40) END AS section_id FROM sec_a"""
)
def section_ids(spark, sf_dir):
    return _cut(spark, sf_dir).select("doc_id", "ordinal", "section_id")


@query(
    _with(_sections("a"))
    + """SELECT * EXCLUDE (parent0) FROM (SELECT doc_id, ordinal::BIGINT AS ordinal, coalesce(level, 0)::BIGINT AS level, CASE WHEN level >= 2 THEN last_value(CASE WHEN level = 1 THEN ordinal::BIGINT END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent0, coalesce(parent0, -1) AS parent FROM sec_a)"""
)
def parent_links(spark, sf_dir):
    s = _cut(spark, sf_dir)
    ids = s.select("doc_id", F.col("section_id").alias("parent_id"), F.col("ordinal").alias("parent"))
    return s.join(ids, ["doc_id", "parent_id"], "left").select("doc_id", "ordinal", F.col("level").cast("long").alias("level"), F.coalesce("parent", F.lit(-1)).alias("parent"))


@query(_with(_sections("a")) + r"""SELECT doc_id, ordinal::BIGINT AS ordinal, array_to_string(list_transform(list_filter(body, lambda x: regexp_matches(x, '^\d+\.\s+.+') AND NOT regexp_matches(x, '^.+?[.…·]{3,}\s*\d{1,4}\s*$')), lambda x: regexp_extract(x, '^(\d+)\.', 1)), ',') AS numbers FROM sec_a WHERE n_children > 0""")
def child_items(spark, sf_dir):
    s = _cut(spark, sf_dir).filter(F.size("children") > 0)
    return s.select("doc_id", "ordinal", F.array_join(F.transform("children", lambda c: c["item_number"]), ",").alias("numbers"))


@query(_with(_sections("a")) + rf"""SELECT count(*) AS n, count(*) FILTER (len(string_split({_toc('title')}, ' ')) >= 8 AND len(body) > 0 AND regexp_matches(body[1], '^[a-z(,;]') AND NOT regexp_matches({_toc('title')}, '[.?!]$')) AS wrapped FROM sec_a WHERE label IN ('major_heading', 'named_numbered_heading')""")
def title_continuations(spark, sf_dir):
    s = _cut(spark, sf_dir).filter(F.col("debug_label").isin("major_heading", "named_numbered_heading"))
    return s.agg(F.count("*").alias("n"), F.count_if(F.col("title") != T.strip_toc(F.col("raw_title"))).alias("wrapped"))


@query(_with(_sections("a")) + "SELECT doc_id, min(line_no // 4 + 1) AS page FROM lev_a JOIN (SELECT doc_id AS d FROM sec_a WHERE ordinal = 0) ON d = doc_id GROUP BY doc_id")
def preamble_pages(spark, sf_dir):
    return _cut(spark, sf_dir).filter("section_id = 'preamble'").select("doc_id", F.col("start_page").cast("long").alias("page"))


# --- text functions over documents -----------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9%$€£.,/-]+'))::BIGINT AS n FROM documents")
def token_counts(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))


@query(rf"SELECT doc_id, len(list_filter(string_split(regexp_replace({_collapse(_TEXT)}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::BIGINT AS n FROM documents")
def sentence_counts(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query(_with(_sections("a")) + rf"SELECT doc_id, ordinal::BIGINT AS ordinal, CASE WHEN regexp_matches(title, '^[IVXLCDMivxlcdm]+\.\s+') THEN regexp_extract(title, '^([A-Za-z]+)\.', 1) WHEN regexp_matches(title, '^\d+\.\s+') THEN regexp_extract(title, '^(\d+)', 1) WHEN regexp_matches(title, '^[A-Za-z]\.\s+') THEN left(title, 1) WHEN regexp_matches(title, '(?i)^(principle|article|section|chapter|standard|rule)\s+(\d+[a-z]?)([^\p{{L}}\p{{N}}_]|$)') THEN regexp_extract(title, '(?i)^(principle|article|section|chapter|standard|rule)\s+(\d+[a-z]?)', 2) ELSE 'none' END AS number FROM sec_a WHERE ordinal > 0")
def section_numbers(spark, sf_dir):
    heads = sections.leveled(_body(spark, sf_dir)).filter("level is not null")
    return heads.select("doc_id", "ordinal", T.section_number(F.col("text"), F.lit("none")).alias("number"))


# --- layout ----------------------------------------------------------------------------


@query(_with(_lines("a")) + rf"""SELECT region, norm, count(*) AS n FROM (SELECT CASE WHEN y1 <= 800 * 0.12 THEN 'top' WHEN y0 >= 800 * (1 - 0.12) THEN 'bottom' END AS region, regexp_replace(lower(text), '\b\d+\b', '<num>', 'g') AS norm FROM lines_a WHERE text <> '') WHERE region IS NOT NULL GROUP BY ALL""")
def edge_candidates(spark, sf_dir):
    lines, pages = corpus.layout(corpus.documents(spark, sf_dir))
    return layout.edge_candidates(lines, pages).groupBy("region", "norm").agg(F.count("*").alias("n"))


_NUMBER = r"regexp_matches({}, '(?i)^(page\s+)?\d+(\s*/\s*\d+)?$')"

#: Edge lines with the share of pages that hold their normal form, and the removable ones.  No two forms of one
#: document and band are alike without being equal here, so equality stands for the fuzzy clusters.
_EDGES = rf"""t_a AS (SELECT doc_id, line_no, page, {_collapse('text')} AS text, CASE WHEN y1 <= 800 * 0.12 THEN 'top' WHEN y0 >= 800 * (1 - 0.12) THEN 'bottom' END AS region FROM lines_a),
edge AS (SELECT *, regexp_replace(lower(text), '\b\d+\b', '<num>', 'g') AS norm FROM t_a WHERE region IS NOT NULL AND text <> ''),
share AS (SELECT e.*, count(*) OVER (PARTITION BY e.doc_id, region, norm) / p.n AS share FROM edge e JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM pages_a GROUP BY doc_id) p ON e.doc_id = p.doc_id),
gone AS (SELECT doc_id, page, text, min(CASE WHEN {_NUMBER.format('text')} THEN 'page_number' WHEN share >= 0.6 THEN 'repeat' END) AS reason FROM share GROUP BY ALL HAVING reason IS NOT NULL)"""


@query(
    _with(_lines("a"), _EDGES)
    + rf"""SELECT doc_id, count(DISTINCT page) AS pages, count(*) AS lines, count(*) FILTER (r AND text <> '') AS removed, count(*) FILTER (NOT r AND text <> '') AS remaining
 FROM (SELECT t.*, gone.reason IS NOT NULL OR {_NUMBER.format('t.text')} AS r FROM t_a t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.page = gone.page AND t.text = gone.text) GROUP BY doc_id"""
)
def extraction_summary(spark, sf_dir):
    lines, pages = corpus.layout(corpus.documents(spark, sf_dir))
    return layout.extraction_summary(layout.clean_lines(lines, pages), pages)


@query(_with(_lines("a")) + r"SELECT doc_id, count(*) AS n FROM lines_a WHERE regexp_matches(text, '(?i)^(page\s+)?\d+(\s*/\s*\d+)?$') GROUP BY doc_id")
def page_number_lines(spark, sf_dir):
    lines, _ = corpus.layout(corpus.documents(spark, sf_dir))
    return lines.filter(T.is_page_number(F.col("text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_with(_lines("a")) + r"SELECT doc_id, count(*) AS n FROM lines_a WHERE length(text) >= 20 AND regexp_matches(text, '(^|[^\p{L}\p{N}_])\d{1,4}$') AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 12 AND regexp_matches(lower(text), '[a-z]') GROUP BY doc_id")
def running_titles(spark, sf_dir):
    lines, _ = corpus.layout(corpus.documents(spark, sf_dir))
    # the normal form of a number has letters of its own; here the line must have some
    return lines.filter(layout.running_title(F.col("text")) & F.lower("text").rlike("[a-z]")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(_with(_lines("a")) + f"SELECT doc_id, page, count(*) FILTER (trim(text) <> '') AS n_lines, sum(length({_collapse('text')})) FILTER (trim(text) <> '')::BIGINT AS n_chars FROM lines_a GROUP BY doc_id, page HAVING count(*) FILTER (trim(text) <> '') > 0")
def span_lines(spark, sf_dir):
    """Every line cut into a span per word, then put together again."""
    lines, _ = corpus.layout(corpus.documents(spark, sf_dir))
    # few bytes of lines become many of spans to sort: tasks grow in number with the documents, not in size
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_of(spark, f"{sf_dir}/documents.parquet") // SPAN_BYTES)
    spans = lines.repartition(tasks, "doc_id").select("doc_id", "page", F.col("line_no").alias("block"), "y0", "y1", F.posexplode(F.split("text", " ")).alias("k", "text"))
    spans = spans.select("doc_id", "page", "block", (F.col("block") * 1000000 + F.col("k")).alias("span_no"), "text", (F.lit(50.0) + F.col("k")).alias("x0"), (F.col("y0") + F.col("k") % 2).alias("y0"), (F.lit(51.0) + F.col("k")).alias("x1"), "y1")
    got = layout.lines_from_spans(spans)
    return got.groupBy("doc_id", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(_with(_lines("a"), _EDGES) + "SELECT doc_id, page, text, reason FROM gone")
def edge_clusters(spark, sf_dir):
    lines, pages = corpus.layout(corpus.documents(spark, sf_dir))
    return layout.removable(lines, pages).select("doc_id", F.col("page").cast("long").alias("page"), "text", "reason")


# --- matching --------------------------------------------------------------------------

_POOLS = ",\n".join(f"pool_{v} AS (SELECT doc_id, ordinal, label, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM sec_{v} WHERE level = 1)" for v in "ab")


@query(_with(_sections("a"), _sections("b"), _POOLS) + "SELECT a.doc_id AS pair_id, count(*) AS n, sum(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.4 END) AS anchor, sum(greatest(0.0, 1 - abs(a.i - b.i) / greatest(1, greatest(a.n, b.n) - 1))) AS in_order FROM pool_a a JOIN pool_b b USING (doc_id) GROUP BY a.doc_id")
def candidate_terms(spark, sf_dir):
    a, b = (matching.pool(_cut(spark, sf_dir, v).withColumn("pair_id", F.col("doc_id"))) for v in "ab")
    c = matching.plain_terms(matching.candidates(a, b))
    return c.groupBy("pair_id").agg(F.count("*").alias("n"), F.sum("anchor_score").alias("anchor"), F.sum("order_score").alias("in_order"))


@query()
def section_matches(spark, sf_dir):
    return compare.corpus_comparison(spark, sf_dir)["matches"]


# --- differences -----------------------------------------------------------------------


_PAIRS = rf"""k AS (SELECT a.doc_id AS pair_id, a.ordinal, CASE WHEN {_norm('a.title')} = {_norm('b.title')} AND lower(array_to_string(a.body, ' ')) = lower(array_to_string(b.body, ' ')) THEN 'unchanged' ELSE 'changed' END AS status
 FROM sec_a a JOIN sec_b b ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal WHERE a.ordinal > 0)"""


@query(_with(_sections("a"), _sections("b"), _PAIRS) + "SELECT pair_id, count(*) AS n, count(*) FILTER (status = 'unchanged') AS unchanged FROM k GROUP BY pair_id")
def section_status(spark, sf_dir):
    rows = diffing.statuses(_keyed(spark, sf_dir).filter("diff_no > 0"))
    return rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "unchanged").alias("unchanged"))


def _versions(spark, sf_dir):
    """Lines of both versions side by side: pair_id, diff_no, before_text, after_text."""
    rows = corpus.both_versions(corpus.body_lines(corpus.documents(spark, sf_dir)))
    place = (F.floor(F.col("line_no") / 4) + 1) * 10 + 1 + F.col("line_no") % 4  # as in a layout
    return rows.select(F.col("doc_id").alias("pair_id"), place.alias("diff_no"), F.col("text_a").alias("before_text"), F.col("text_b").alias("after_text"))


_VERSIONS = "v AS (SELECT a.doc_id AS pair_id, a.text AS ta, b.text AS tb FROM body_a a JOIN body_b b ON a.doc_id = b.doc_id AND a.line_no = b.line_no)"


def _cue(side: str, cues) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(side, c.replace("'", "''")) for c in cues) + ")"


@query(
    _with(_VERSIONS)
    + "SELECT pair_id, "
    + ", ".join(f"count(*) FILTER ({_cue('ta', c)} <> {_cue('tb', c)}) AS {n}" for n, c in (("obligation", classify.OBLIGATION), ("negation", classify.NEGATION), ("scope", classify.SCOPE)))
    + r", count(*) FILTER (regexp_matches(ta, '\||\t|\s{3,}\S+\s{3,}') <> regexp_matches(tb, '\||\t|\s{3,}\S+\s{3,}')) AS tables FROM v GROUP BY pair_id"
)
def cue_flips(spark, sf_dir):
    f = classify.value_features(_versions(spark, sf_dir))
    return f.groupBy("pair_id").agg(F.count_if("obligation_change").alias("obligation"), F.count_if("negation_change").alias("negation"), F.count_if("scope_change_cues").alias("scope"), F.count_if("table_change_detected").alias("tables"))


_TOK = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9%$€£.,/-]+'), lambda x: lower(x)))"


@query(_with(_VERSIONS, f"t AS (SELECT pair_id, {_TOK.format('ta')} AS x, {_TOK.format('tb')} AS y FROM v)") + "SELECT pair_id, round(sum(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) END), 4) AS jaccard FROM t GROUP BY pair_id")
def token_jaccard(spark, sf_dir):
    f = classify.value_features(_versions(spark, sf_dir))
    return f.groupBy("pair_id").agg(F.round(F.sum("token_jaccard"), 4).alias("jaccard"))


@query(_with(_sections("a"), _sections("b")) + "SELECT a.doc_id AS pair_id, a.ordinal::BIGINT AS diff_no, lower(coalesce(a.title, 'Preamble')) AS title FROM sec_a a JOIN sec_b b ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal WHERE a.ordinal > 0 AND lower(a.title || ' ' || b.title) LIKE '%principle 2%'")
def filtered_list(spark, sf_dir):
    rows = sections.leveled(_body(spark, sf_dir)).filter("level is not null").select(F.col("doc_id").alias("pair_id"), F.col("ordinal").alias("diff_no"), F.col("text").alias("title_a"))
    other = sections.leveled(_body(spark, sf_dir, "b")).filter("level is not null").select(F.col("doc_id").alias("pair_id"), F.col("ordinal").alias("diff_no"), F.col("text").alias("title_b"))
    rows = rows.join(other, ["pair_id", "diff_no"])
    # the diff of the titles stands for that of the sections, which SQL can't express; beyond the first of its lines
    title = diffing.title_diffs(F.col("title_a"), F.col("title_b"), F.lit("a"), F.lit("b"))
    rows = rows.withColumn("semantic_unified_diff", F.lit("")).withColumn("unified_diff", title["unified_diff"])
    return report.filtered(rows, "all", "Principle 2").select("pair_id", "diff_no", F.lower("title_a").alias("title"))


# --- annotations (events as an append log) ---------------------------------------------


@query("""SELECT conv_id::VARCHAR AS pair_id, turn::VARCHAR AS page_number_file_a, '2' AS section_number_file_a, sha256(CASE WHEN trim(coalesce(text, '')) = '' THEN '2. T' ELSE text END) AS text_file_a, sha256('say "x"' || chr(10) || 'y, z') AS text_file_b, turn / 4 AS diff_score FROM conversations""")
def stored_sheets(spark, sf_dir):
    """The same as workbooks, a file a pair, read back from their parts."""
    path = f"{shared_dir(spark)}/sheets-{uuid.uuid4().hex}"
    sheets.write_sheets(report.export_rows(_turn_diffs(spark, sf_dir)), path)
    rows = sheets.read_sheets(spark, path)
    return rows.select("pair_id", "page_number_file_a", "section_number_file_a", F.sha2("text_file_a", 256).alias("text_file_a"), F.sha2("text_file_b", 256).alias("text_file_b"), "diff_score")


@query("SELECT user_id AS pair_id, event_type AS diff_id, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def latest_annotations(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("pair_id"), F.col("event_type").alias("diff_id"), F.col("event_id").alias("seq"), "value")
    return report.latest(log, ["pair_id", "diff_id"])


@query(
    """WITH d AS (SELECT conv_id AS pair_id, turn AS diff_no, role AS section_id_a, CASE WHEN turn % 3 = 0 THEN '' ELSE 's' || turn END AS section_id_b FROM conversations),
i AS (SELECT *, diff_no || ':' || coalesce(nullif(section_id_a, ''), 'none') || '->' || coalesce(nullif(section_id_b, ''), 'none') AS diff_id FROM d)
SELECT pair_id, diff_id, CASE WHEN diff_no % 2 = 0 THEN 'approved' ELSE 'needs_review' END AS validation_status, CASE WHEN diff_no % 5 = 0 THEN 'slight' WHEN section_id_b = 's1' THEN 'editorial' END AS change_classification,
 CASE WHEN diff_no % 5 = 0 THEN 'manual' WHEN section_id_b = 's1' THEN 'classified_report' END AS classification_source FROM i"""
)
def annotation_overlay(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("diff_no"), F.col("role").alias("section_id_a"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("section_id_b"))
    ids = report.with_diff_id(t)
    reviews = ids.filter("diff_no % 2 = 0").select("pair_id", "diff_id", F.lit("approved").alias("validation_status"), F.lit("").alias("reviewer"), F.lit("").alias("note"), F.lit(1).alias("seq"))
    labels = ids.filter("diff_no % 5 = 0").select("pair_id", "diff_id", F.lit("slight").alias("classification"), F.lit("manual").alias("source"), F.lit(1).alias("seq"))
    external = t.select("pair_id").distinct().select("pair_id", F.lit("s1").alias("section_id"), F.lit("editorial").alias("label"))
    return report.overlay(t, reviews, labels, external).select("pair_id", "diff_id", "validation_status", "change_classification", "classification_source")


# --- whole comparisons (difflib: no SQL) -----------------------------------------------


@query()
def diff_summary(spark, sf_dir):
    found = compare.corpus_comparison(spark, sf_dir)
    return diffing.quality(diffing.summary(found["diffs"], found["pairs"]))


@query()
def export_rows(spark, sf_dir):
    return report.export_rows(compare.corpus_comparison(spark, sf_dir)["texts"])


@query()
def diff_rows(spark, sf_dir):
    return diffing.row_pairs(compare.corpus_comparison(spark, sf_dir)["diffs"])


#: Lengths of common subsequences, a row of the table after the other; each next row is a running maximum.
#: Equal tokens at the beginning add nothing to either side.
_LCS = """tok AS (SELECT pair_id, diff_no, x[p + 1:] AS x, y[p + 1:] AS y FROM (SELECT *, coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda k: x[k] <> y[k])), least(len(x), len(y)) + 1) - 1 AS p FROM (
 SELECT pair_id, (line_no // 4 + 1) * 10 + 1 + line_no % 4 AS diff_no, regexp_extract_all(ta, '\\s+|\\S+') AS x, regexp_extract_all(tb, '\\s+|\\S+') AS y FROM (
 SELECT a.doc_id AS pair_id, a.line_no, a.text AS ta, b.text AS tb FROM body_a a JOIN body_b b ON a.doc_id = b.doc_id AND a.line_no = b.line_no WHERE a.text <> b.text)))),
lcs AS (SELECT pair_id, diff_no, x, y, 0 AS i, list_transform(range(len(y) + 1), lambda k: 0) AS r FROM tok
 UNION ALL SELECT pair_id, diff_no, x, y, i + 1, list_transform(range(1, len(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN k > 1 AND y[k - 1] = x[i + 1] THEN r[k - 1] + 1 ELSE r[k] END))) FROM lcs WHERE i < len(x))"""


@query(_with(_LCS).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT pair_id, diff_no, (len(x) - r[len(y) + 1])::INTEGER AS deleted, (len(y) - r[len(y) + 1])::INTEGER AS added FROM lcs WHERE i = len(x)")
def inline_diffs(spark, sf_dir):
    rows = _versions(spark, sf_dir).filter("before_text <> after_text")
    d = rows.withColumn("d", S.inline_diff(F.col("before_text"), F.col("after_text")))
    return d.select("pair_id", "diff_no", F.size(F.filter("d.left", lambda x: x["op"] == "del")).alias("deleted"), F.size(F.filter("d.right", lambda x: x["op"] == "add")).alias("added"))


@query()
def change_classification(spark, sf_dir):
    return compare.corpus_classification(spark, sf_dir).select("pair_id", "diff_no", "section_id", "change_ratio", "token_jaccard", "sentence_overlap", "rule_label", F.array_join("triggered_rules", ",").alias("rules"), "model_label", "disagreement", "override_candidate", "final_classification")


@query()
def classification_summary(spark, sf_dir):
    found = compare.corpus_comparison(spark, sf_dir)
    return classify.summary(classify.classified(found["texts"], ratios=False), found["pairs"])


# --- single operators ------------------------------------------------------------------


@query(f"SELECT doc_id, left({_collapse('lower(' + _TEXT + ')')}, 240) AS prefix FROM documents")
def body_prefixes(spark, sf_dir):
    return corpus.documents(spark, sf_dir).select("doc_id", T.body_prefix(F.coalesce("text", F.lit(""))).alias("prefix"))


_NAMED = r"'(?i)^(principle|article|section|chapter|standard|rule)\s+\d+[a-z]?\s*[:.-]?\s*'"


def _core(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({_norm(c)}, '^(?:[ivxlcdm]+|\d+|[a-z])\s*', ''), {_NAMED}, ''))"


@query(_with(_sections("a")) + rf"SELECT doc_id, ordinal::BIGINT AS ordinal, {_collapse(rf"regexp_replace(regexp_replace(title, '(?i)^([ivxlcdm]+|\d+|[a-z])\s*[.)-]\s*', ''), {_NAMED}, '')")} AS stripped, {_core('title')} AS core FROM sec_a WHERE ordinal > 0")
def title_cores(spark, sf_dir):
    heads = sections.leveled(_body(spark, sf_dir)).filter("level is not null")
    return heads.select("doc_id", "ordinal", T.strip_heading(F.col("text")).alias("stripped"), T.title_core(F.col("text")).alias("core"))


@query(_with(_lines("a"), _EDGES) + rf"""SELECT doc_id, reason, count(*) AS n FROM (SELECT t.doc_id, CASE WHEN t.text = '' THEN 'blank' WHEN gone.reason IS NOT NULL THEN gone.reason WHEN regexp_matches(t.text, '(?i)^principle 2|usd 1[02],000') THEN 'pattern'
 WHEN {_NUMBER.format('t.text')} THEN 'page_number' WHEN regexp_matches(t.text, '(?i)^b\. ') THEN 'noise' ELSE 'kept' END AS reason
 FROM t_a t LEFT JOIN gone ON t.doc_id = gone.doc_id AND t.page = gone.page AND t.text = gone.text) GROUP BY ALL""")
def removal_reasons(spark, sf_dir):
    lines, pages = corpus.layout(corpus.documents(spark, sf_dir))
    cfg = LayoutConfig(header_patterns=("^principle 2",), footer_patterns=("usd 1[02],000",), ignore_patterns=(r"^b\. ",))
    return layout.clean_lines(lines, pages, cfg).groupBy("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(rf"SELECT doc_id, len(u)::BIGINT AS n, sha256(array_to_string(u, chr(10))) AS units FROM (SELECT doc_id, list_filter(string_split(regexp_replace({_collapse(_TEXT)}, '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS u FROM documents)")
def semantic_units(spark, sf_dir):
    u = T.semantic_units(F.col("text"))
    return corpus.documents(spark, sf_dir).select("doc_id", F.size(u).cast("long").alias("n"), F.sha2(F.array_join(u, "\n"), 256).alias("units"))


_WRAPS = r"""w AS (SELECT doc_id, line_no, text, lag(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS last FROM body_a WHERE trim(text) <> ''),
p AS (SELECT doc_id, line_no, trim(text) AS text, last IS NULL OR regexp_matches(trim(last), '[.?!:;]$') OR regexp_matches(trim(text), '^\d+[.)]\s+') OR regexp_matches(trim(text), '^[A-Z][A-Z0-9\s-]{3,}$')
 OR NOT (regexp_matches(trim(text), '^[a-z(,;]') OR regexp_matches(trim(last), '(?i)(^|[^\p{L}\p{N}_])(and|or|to|of|in|for|with|on|at|by|from|under|within)$')) AS fresh FROM w)"""


@query(_with(_WRAPS) + "SELECT doc_id, count(*) FILTER (fresh) AS n, sha256(substr(string_agg(CASE WHEN fresh THEN chr(10) ELSE ' ' END || text, '' ORDER BY line_no), 2)) AS paragraphs FROM p GROUP BY doc_id")
def soft_wraps(spark, sf_dir):
    """The lines of each document with soft wraps joined."""
    lines = _body(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]).alias("lines"))
    u = diffing.unwrapped(F.col("lines"))
    return lines.withColumn("u", u).filter(F.size("u") > 0).select("doc_id", F.size("u").cast("long").alias("n"), F.sha2(F.array_join("u", "\n"), 256).alias("paragraphs"))


#: Word ends follow Unicode in Spark and ASCII in SQL; letters beyond ASCII become x there.
_ASCII = "regexp_replace({}, '[\u00c0-\u024f]', 'x', 'g')"


def _set_changes(pattern: str) -> str:
    a, b = (f"list_distinct(list_transform(regexp_extract_all({_ASCII.format(c)}, '{pattern}'), lambda v: lower(v)))" for c in ("ta", "tb"))
    return f"sum(len(list_filter({a}, lambda v: NOT list_contains({b}, v))) + len(list_filter({b}, lambda v: NOT list_contains({a}, v))))::BIGINT"


@query(_with(_VERSIONS) + "SELECT pair_id, " + ", ".join(f"{_set_changes(p.replace('(?U)', '').replace('(?iU)', '(?i)'))} AS {n}" for n, p in (("numbers", classify.NUMBERS), ("percents", classify.PERCENTS), ("currencies", classify.CURRENCIES), ("dates", classify.DATES))) + " FROM v GROUP BY pair_id")
def value_changes(spark, sf_dir):
    f = classify.value_features(_versions(spark, sf_dir))
    total = lambda c: F.sum(c).cast("long")
    return f.groupBy("pair_id").agg(total("numeric_changes_count").alias("numbers"), total("percentages_changed").alias("percents"), total("currency_changed").alias("currencies"), total("dates_changed").alias("dates"))


def _sentences(c: str) -> str:
    return rf"list_distinct(list_filter(string_split(regexp_replace(lower({_collapse(c)}), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))"


@query(_with(_VERSIONS, f"t AS (SELECT pair_id, {_sentences('ta')} AS x, {_sentences('tb')} AS y FROM v)") + "SELECT pair_id, round(sum(CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) END), 4) AS overlap FROM t GROUP BY pair_id")
def sentence_overlap(spark, sf_dir):
    f = classify.value_features(_versions(spark, sf_dir))
    return f.groupBy("pair_id").agg(F.round(F.sum("sentence_overlap"), 4).alias("overlap"))


@query(_with(_sections("a")) + "SELECT s.doc_id, s.ordinal::BIGINT AS ordinal, min(l.line_no // 4 + 1) AS start_page, max(l.line_no // 4 + 1) AS end_page FROM sec_a s JOIN lev_a l ON s.doc_id = l.doc_id AND s.ordinal = l.ordinal WHERE s.ordinal > 0 GROUP BY ALL")
def section_pages(spark, sf_dir):
    return _cut(spark, sf_dir).filter("ordinal > 0").select("doc_id", "ordinal", F.col("start_page").cast("long").alias("start_page"), F.col("end_page").cast("long").alias("end_page"))


def _whole(v: str) -> str:
    """Sections with their first page, titles with a line that they go on in, and that line no more in the body."""
    wrapped = f"(label IN ('major_heading', 'named_numbered_heading') AND len(string_split(t, ' ')) >= 8 AND len(body) > 0 AND regexp_matches(body[1], '^[a-z(,;]') AND NOT regexp_matches(t, '[.?!]$'))"
    return (
        f"full_{v} AS (SELECT doc_id, ordinal, page, CASE WHEN {wrapped} THEN t || ' ' || body[1] ELSE t END AS title, CASE WHEN {wrapped} THEN body[2:] ELSE body END AS body"
        f" FROM (SELECT s.doc_id, s.ordinal, {_toc('s.title')} AS t, s.label, s.body, min(l.line_no // 4 + 1) AS page FROM sec_{v} s JOIN lev_{v} l ON s.doc_id = l.doc_id AND s.ordinal = l.ordinal WHERE s.ordinal > 0 GROUP BY ALL))"
    )


_STATUS = rf"""{_whole('a')}, {_whole('b')},
k AS (SELECT a.doc_id AS pair_id, a.title AS ta, b.title AS tb, {_norm('a.title')} = {_norm('b.title')} AS t, lower(array_to_string(a.body, ' ')) = lower(array_to_string(b.body, ' ')) AS same, {_norm('a.title')} <> {_norm('b.title')} AND {_core('a.title')} = {_core('b.title')} AS renumbered,
 lower(a.title || ' ' || array_to_string(a.body, ' ')) = lower(b.title || ' ' || array_to_string(b.body, ' ')) AS whole FROM full_a a JOIN full_b b ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal)"""


@query(
    _with(_sections("a"), _sections("b"), _STATUS)
    + "SELECT CASE WHEN t AND same THEN 'unchanged' WHEN same AND renumbered THEN 'renumbering_only' ELSE 'modified' END AS status, CASE WHEN whole THEN 'unchanged' WHEN same AND renumbered THEN 'renumbering_only' ELSE 'modified' END AS semantic_status,"
    " CASE WHEN t THEN 'unchanged' ELSE 'modified' END AS title_status, count(*) AS n, sum(length(CASE WHEN ta = tb THEN '' ELSE '--- a' || chr(10) || '+++ b' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || ta || chr(10) || '+' || tb END))::BIGINT AS n_chars FROM k GROUP BY ALL"
)
def section_statuses(spark, sf_dir):
    rows = diffing.statuses(_keyed(spark, sf_dir).filter("diff_no > 0"))
    rows = rows.withColumn("d", diffing.title_diffs(F.col("title_a"), F.col("title_b"), F.lit("a"), F.lit("b")))
    return rows.groupBy("status", "semantic_status", F.col("d.status").alias("title_status")).agg(F.count("*").alias("n"), F.sum(F.length("d.unified_diff")).alias("n_chars"))


@query(
    _with(_sections("a"), _sections("b"), _whole("a"), _whole("b"))
    + r"""SELECT a.doc_id AS pair_id, a.ordinal::BIGINT AS diff_no, a.page::VARCHAR AS page_number_file_a, b.page::VARCHAR AS page_number_file_b, sha256(a.title || CASE WHEN len(a.body) > 0 THEN chr(10) || array_to_string(list_filter(a.body, lambda x: x <> ''), chr(10)) ELSE '' END) AS text_file_a, sha256(b.title) AS text_file_b, 0.5::DOUBLE AS diff_score
 FROM full_a a JOIN full_b b ON a.doc_id = b.doc_id AND a.ordinal = b.ordinal"""
)
def export_columns(spark, sf_dir):
    """The tabular export: A with its lines, B with nothing but its title; texts as hashes."""
    rows = _keyed(spark, sf_dir).filter("diff_no > 0").withColumn("score", F.lit(0.5))
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("section_lines_a", diffing.section_lines(F.col("title_a"), F.col("body_lines_a"))).withColumn("section_lines_b", none)
    rows = report.export_rows(rows.withColumn("semantic_text_a", F.lit(" ")).withColumn("semantic_text_b", F.lit(None).cast("string")))
    rows = rows.withColumn("text_file_a", F.sha2("text_file_a", 256)).withColumn("text_file_b", F.sha2("text_file_b", 256))
    return rows.drop("section_number_file_a", "section_number_file_b")


# --- assignment, rules and summaries over plain tables ----------------------------------

_SIDES = """sides AS (SELECT l_orderkey AS pair_id, l_linenumber - 1 AS i, l_partkey, l_suppkey FROM lineitem),
scores AS (SELECT a.pair_id, a.i AS i_a, b.i AS i_b, (40 + (a.l_partkey * 7 + b.l_suppkey * 13 + a.i * b.i) % 60) / 100 AS score FROM sides a JOIN sides b ON a.pair_id = b.pair_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, i_a, i_b) AS k FROM scores WHERE score >= 0.55),
taken AS (SELECT pair_id, k, [i_a] AS used_a, [i_b] AS used_b, i_a, i_b, score, true AS ok FROM ranked WHERE k = 1
 UNION ALL SELECT r.pair_id, r.k, CASE WHEN list_contains(t.used_a, r.i_a) OR list_contains(t.used_b, r.i_b) THEN t.used_a ELSE list_append(t.used_a, r.i_a) END, CASE WHEN list_contains(t.used_a, r.i_a) OR list_contains(t.used_b, r.i_b) THEN t.used_b ELSE list_append(t.used_b, r.i_b) END,
 r.i_a, r.i_b, r.score, NOT (list_contains(t.used_a, r.i_a) OR list_contains(t.used_b, r.i_b)) FROM taken t JOIN ranked r ON t.pair_id = r.pair_id AND r.k = t.k + 1),
hit AS (SELECT pair_id, k, i_a, i_b, score FROM taken WHERE ok),
every AS (SELECT pair_id, 0 AS kind, k, i_a, i_b, score FROM hit UNION ALL SELECT pair_id, 1, i, i, NULL, 0 FROM sides s WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.pair_id = s.pair_id AND hit.i_a = s.i)
 UNION ALL SELECT pair_id, 2, i, NULL, i, 0 FROM sides s WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.pair_id = s.pair_id AND hit.i_b = s.i))"""


@query(f"WITH RECURSIVE {_SIDES} SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY kind, k) - 1 AS match_no, 'a' || i_a AS section_id_a, 'b' || i_b AS section_id_b, round(score, 4) AS score, CASE WHEN i_a IS NULL OR i_b IS NULL THEN 'unmatched' WHEN score >= 0.78 THEN 'matched' ELSE 'low-confidence matched' END AS confidence FROM every")
def greedy_assignment(spark, sf_dir):
    """One-to-one assignment, confidence bands and outer rows over the lines of orders, with scores by arithmetic."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") - 1).cast("long").alias("i"), "l_partkey", "l_suppkey")
    a, b = (items.withColumn("section_id", F.concat(F.lit(s), F.col("i").cast("string"))) for s in "ab")
    side = lambda df, s: df.select("pair_id", *[F.col(c).alias(f"{c}_{s}") for c in ("i", "section_id", "l_partkey", "l_suppkey")])
    c = side(a, "a").join(side(b, "b"), "pair_id")
    c = c.withColumn("score", (40 + (F.col("l_partkey_a") * 7 + F.col("l_suppkey_b") * 13 + F.col("i_a") * F.col("i_b")) % 60) / 100).filter("score >= 0.55").withColumn("reason", F.lit(""))
    return matching.matches(a, b, matching.assigned(c)).drop("reason")


_LETTERS = """items AS (SELECT l_orderkey AS pair_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_linestatus AS anchor, l_partkey AS p, l_suppkey AS s, l_linenumber AS l FROM lineitem
 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus)),
sides AS (SELECT pair_id, i FROM items),
scores AS (SELECT a.pair_id, a.i AS i_a, b.i AS i_b, 0.65::DOUBLE * (0.35::DOUBLE * (a.p % 3 = b.s % 3)::INT + 0.65::DOUBLE * (a.s % 4 = b.s % 4)::INT) + 0.25::DOUBLE * (a.p % 5 > 0 AND a.l % 2 = b.p % 2)::INT
 + 0.05::DOUBLE * (CASE WHEN a.anchor = b.anchor THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END) + 0.05::DOUBLE * (1 - abs(a.i - b.i)::DOUBLE / greatest(1, a.n - 1)) AS score FROM items a JOIN items b ON a.pair_id = b.pair_id),
ranked AS""" + _SIDES.split("ranked AS", 1)[1]


def _letters(spark, sf_dir):
    """The lines of orders as sections of one letter, of which the similarity is 1 or 0."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    own = Window.partitionBy("l_orderkey")
    at = (F.row_number().over(own.orderBy(*order)) - 1).cast("long")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("pair_id"), at.alias("i"), F.count("*").over(own).alias("n"), F.col("l_linestatus").alias("anchor_type"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("l"))
    rows = written(rows, "letters")  # both sides are these rows
    letter = lambda c, k: F.element_at(F.array(*map(F.lit, "xyzéq")), (F.pmod(c, F.lit(k)) + 1).cast("int"))
    a = rows.withColumn("title_normalized", letter("p", 3)).withColumn("core", letter("s", 4)).withColumn("prefix", F.when(F.col("p") % 5 > 0, letter("l", 2)).otherwise(""))
    b = rows.withColumn("title_normalized", letter("s", 3)).withColumn("core", letter("s", 4)).withColumn("prefix", letter("p", 2))
    return [side.withColumn("section_id", F.concat(F.lit(v), F.col("i").cast("string"))) for v, side in (("a", a), ("b", b))]


_ASSIGNED = "SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY kind, k) - 1 AS match_no, 'a' || i_a AS section_id_a, 'b' || i_b AS section_id_b, round(score, 4) AS score, CASE WHEN i_a IS NULL OR i_b IS NULL THEN 'unmatched' WHEN score >= 0.78 THEN 'matched' ELSE 'low-confidence matched' END AS confidence FROM every"


@query(f"WITH RECURSIVE {_LETTERS} {_ASSIGNED}")
def lazy_assignment(spark, sf_dir):
    """The assignment that plans use, over sections of one letter."""
    a, b = _letters(spark, sf_dir)
    return matching.matches(a, b, matching.assigned_lazily(a, b)).drop("reason")


@query(f"WITH RECURSIVE {_LETTERS} {_ASSIGNED}")
def spread_assignment(spark, sf_dir):
    """The same in rounds over all tasks, as for pairs too large for one: blocks of five by five, as orders have few lines."""
    a, b = _letters(spark, sf_dir)
    return matching.matches(a, b, matching.assigned_widely(a, b, block=25)).drop("reason")


_RULES = """f AS (SELECT l_suppkey AS pair_id, l_discount AS change_ratio, 1 - l_tax AS token_jaccard, 1 - l_discount AS sentence_overlap, l_quantity > 48 AS ob, l_shipdate < '1993-01-01' AS ne, l_linenumber = 7 AS sc, CASE WHEN l_partkey % 29 = 0 THEN 1 ELSE 0 END AS nu, CASE WHEN l_suppkey % 31 = 0 THEN 2 ELSE 0 END AS da,
 CASE l_returnflag WHEN 'A' THEN 'editorial' WHEN 'N' THEN 'slight' ELSE 'significant' END AS model_label FROM lineitem),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN ob THEN 'obligation_change' END, CASE WHEN ne THEN 'negation_change' END, CASE WHEN sc THEN 'scope_change_cues' END, CASE WHEN nu > 0 THEN 'numeric_changes' END, CASE WHEN da > 0 THEN 'date_changes' END], lambda x: x IS NOT NULL), ',') AS hard FROM f),
l AS (SELECT *, CASE WHEN hard <> '' THEN 'significant' WHEN change_ratio <= 0.03 AND token_jaccard >= 0.97 AND sentence_overlap >= 0.95 THEN 'editorial' WHEN change_ratio >= 0.45 OR token_jaccard < 0.5 THEN 'significant' ELSE 'slight' END AS rule_label,
 CASE WHEN hard <> '' THEN hard WHEN change_ratio <= 0.03 AND token_jaccard >= 0.97 AND sentence_overlap >= 0.95 THEN 'high_similarity_low_change_ratio' WHEN change_ratio >= 0.45 OR token_jaccard < 0.5 THEN 'large_change_surface' ELSE 'default_small_semantic_change' END AS rules FROM r)"""


def _ruled(spark, sf_dir, *more, pair=None):
    """Rules, the stub of the model hook with given labels, and arbitration over the lines of orders; ``more``: columns in place of the pair."""
    flag = lambda c, n: F.when(c, n).otherwise(0)
    f = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("pair_id", F.col("l_suppkey") if pair is None else pair).select(
        *(more or ["pair_id"]), F.col("l_discount").alias("change_ratio"), (1 - F.col("l_tax")).alias("token_jaccard"), (1 - F.col("l_discount")).alias("sentence_overlap"), (F.col("l_quantity") > 48).alias("obligation_change"), (F.col("l_shipdate") < "1993-01-01").alias("negation_change"), (F.col("l_linenumber") == 7).alias("scope_change_cues"),
        flag(F.col("l_partkey") % 29 == 0, 1).alias("numeric_changes_count"), flag(F.col("l_suppkey") % 31 == 0, 2).alias("dates_changed"), F.lit(0).alias("percentages_changed"), F.lit(0).alias("currency_changed"),
        F.when(F.col("l_returnflag") == "A", "editorial").when(F.col("l_returnflag") == "N", "slight").otherwise("significant").alias("llm_mock_label"),
    )
    return classify.arbitrated(classify.modelled(classify.ruled(f)))


@query(f"WITH {_RULES} SELECT rule_label, rules, model_label, model_label <> rule_label AS disagreement, CASE WHEN hard <> '' AND model_label IN ('editorial', 'slight') THEN 'significant' ELSE 'none' END AS override_candidate, nu + da > 0 AS numeric_or_value_changes, model_label AS final_classification, count(*) AS n FROM l GROUP BY ALL")
def rule_labels(spark, sf_dir):
    rows = _ruled(spark, sf_dir)
    return rows.groupBy("rule_label", F.array_join("triggered_rules", ",").alias("rules"), "model_label", "disagreement", F.coalesce("override_candidate", F.lit("none")).alias("override_candidate"), F.col("hard_signal_flags.numeric_or_value_changes").alias("numeric_or_value_changes"), "final_classification").agg(F.count("*").alias("n"))


@query(f"WITH {_RULES} SELECT pair_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (model_label = '{k}') AS {k}" for k in classify.LABELS) + ", count(*) FILTER (model_label <> rule_label) AS disagreements FROM l GROUP BY pair_id")
def label_totals(spark, sf_dir):
    return classify.summary(_ruled(spark, sf_dir))


def _by_order(spark, sf_dir):
    """The lines of orders as the classified sections of pairs of documents."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    # numbered within the pair, so that what groups by it later finds the rows together
    no = (F.row_number().over(Window.partitionBy("pair_id").orderBy(*order)) - 1).cast("long")
    return _ruled(spark, sf_dir, "pair_id", no.alias("diff_no"), F.concat(F.lit("s"), (no % 5).cast("string")).alias("section_id"), F.col("l_linestatus").alias("section_title"), pair=F.col("l_orderkey").cast("string"))


_BY_ORDER = _RULES.replace("SELECT l_suppkey AS pair_id,", "SELECT l_orderkey::VARCHAR AS pair_id, no AS diff_no, 's' || (no % 5) AS section_id, l_linestatus AS section_title,").replace(
    "FROM lineitem)", "FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS no FROM lineitem))"
)


@query(f"WITH {_BY_ORDER} SELECT pair_id, diff_no, section_id, section_title, rule_label, rules, model_label, model_label <> rule_label AS disagreement, CASE WHEN hard <> '' AND model_label IN ('editorial', 'slight') THEN 'significant' ELSE 'none' END AS override_candidate FROM l")
def stored_classifications(spark, sf_dir):
    """Classified reports of all orders, a JSON line each, written and read back."""
    path = f"{shared_dir(spark)}/classified-{uuid.uuid4().hex}"
    writers.write_classified(_by_order(spark, sf_dir), path)
    rows = readers.classifications(spark, path)
    rules = F.array_join("rule_classification.triggered_rules", ",").alias("rules")
    return rows.select("pair_id", F.col("pos").cast("long").alias("diff_no"), "section_id", "section_title", F.col("rule_classification.label").alias("rule_label"), rules, F.col("llm_classification.label").alias("model_label"), F.col("disagreement_flag").alias("disagreement"), F.coalesce("override_candidate", F.lit("none")).alias("override_candidate"))


@query(
    f"""WITH {_BY_ORDER}, x AS (SELECT pair_id, section_id, arg_max(model_label, diff_no) AS label FROM l GROUP BY ALL),
d AS (SELECT o_orderkey::VARCHAR AS pair_id, k AS diff_no, 's' || k AS a, CASE WHEN k % 2 = 0 THEN 's' || (k + 1) END AS b FROM orders, range(6) t(k))
SELECT d.pair_id, diff_no || ':' || a || '->' || coalesce(b, 'none') AS diff_id, coalesce(xb.label, xa.label) AS classification FROM d LEFT JOIN x xb ON d.pair_id = xb.pair_id AND d.b = xb.section_id LEFT JOIN x xa ON d.pair_id = xa.pair_id AND d.a = xa.section_id
WHERE coalesce(xb.label, xa.label) IS NOT NULL"""
)
def imported_reports(spark, sf_dir):
    """Diff reports and classified reports of all orders, both stored: the labels of all pairs imported into the log, and the log read."""
    folder = f"{shared_dir(spark)}/imports-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("pair_id"))
    k = F.col("diff_no").cast("string")
    diffs = orders.withColumn("diff_no", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("section_id_a", F.concat(F.lit("s"), k)).withColumn("section_id_b", F.when(F.col("diff_no") % 2 == 0, F.concat(F.lit("s"), (F.col("diff_no") + 1).cast("string"))))
    writers.write_json(diffs, orders.withColumn("total", F.lit(6)), f"{folder}/reports")
    writers.write_classified(_by_order(spark, sf_dir), f"{folder}/classified")
    reports = readers.reports(spark, f"{folder}/reports")
    labels = readers.all_labels(spark, f"{folder}/classified", readers.report_sources(spark, f"{folder}/reports"))
    writers.append_log(report.imported(reports, labels).withColumn("updated_at", F.current_timestamp()), f"{folder}/log")
    return report.latest(spark.read.parquet(f"{folder}/log"), ["pair_id", "diff_id"]).select("pair_id", "diff_id", "classification")


def _first_model(frame):
    """Labels in any case with spaces around them; a confidence for some."""
    size = frame["before_text"].str.len()
    label = (size % 3).map({0: " Editorial", 1: "SLIGHT\n", 2: "other"})
    return frame.assign(label=label, confidence=(size % 5).map(lambda k: None if k == 4 else k / 2), rationale="by " + frame["section_title"])[["label", "confidence", "rationale"]]


def _second_model(frame):
    return frame.assign(text='So: {"label": "significant", "confidence": 0.75}')[["text"]]


@query(
    """WITH r AS (SELECT conv_id AS pair_id, turn AS diff_no, role, coalesce(text, '') AS t, turn % 2 = 0 AS early FROM conversations),
f AS (SELECT *, bool_or(early) OVER (PARTITION BY role, t) AS first FROM r)
SELECT pair_id, diff_no, CASE WHEN NOT first THEN 'significant' WHEN length(t) % 3 = 0 THEN 'editorial' ELSE 'slight' END AS label,
  CASE WHEN NOT first THEN 0.75 WHEN length(t) % 5 = 4 THEN 0.6 ELSE least(1.0, length(t) % 5 / 2) END AS confidence, CASE WHEN first THEN 'by ' || role ELSE 'Model classification.' END AS rationale, false AS stub FROM f"""
)
def stored_answers(spark, sf_dir):
    """A model's answers kept in a table: a first run asks for half of the turns, a second one, with another model, only for what the table lacks."""
    store = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = t.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("diff_no"), F.col("role").alias("section_title"), F.coalesce("text", F.lit("")).alias("before_text"))
    classify.answered(rows.filter("diff_no % 2 = 0"), _first_model, store, "model", "v1")
    found = classify.modelled(rows, _second_model, model="model", store=store)
    return found.select("pair_id", "diff_no", F.col("model_label").alias("label"), F.col("model_confidence").alias("confidence"), "rationale", "stub")


@query(
    """WITH a AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS label, (event_id % 150) / 100 AS confidence FROM events)
SELECT event_id, label, CASE WHEN label IS NOT NULL OR event_id % 3 = 0 THEN confidence END AS confidence FROM a"""
)
def model_answers(spark, sf_dir):
    """Labels read from a model's answers: bare JSON, JSON with words around it, and JSON without a label."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k, given = F.col("event_id") % 3, (F.col("event_id") % 150) / 100
    json = F.when(k > 0, F.to_json(F.struct(F.col("event_type").alias("label"), given.alias("confidence")))).otherwise(F.to_json(F.struct(given.alias("confidence"))))
    told = classify.parse_label(F.when(k == 2, F.concat(F.lit("Well:\n"), json, F.lit(" and no more"))).otherwise(json))
    return e.select("event_id", told["label"].alias("label"), told["confidence"].alias("confidence"))


_EVENT_DIFFS = """d AS (SELECT user_id AS pair_id, CASE event_id % 5 WHEN 0 THEN 'modified' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'added' WHEN 3 THEN 'removed' ELSE 'renumbering_only' END AS status, CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN 'modified' END AS semantic FROM events)"""


def _event_diffs(spark, sf_dir):
    """Events as diffs: a status by number, ids of the sides that it has, and a semantic status of some."""
    e, k = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id") % 5
    status = F.when(k == 0, "modified").when(k == 1, "unchanged").when(k == 2, "added").when(k == 3, "removed").otherwise("renumbering_only")
    has = lambda other: F.when(F.col("status") != other, "s")
    rows = e.select(F.col("user_id").alias("pair_id"), "event_id", status.alias("status"), F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 7 == 1, "modified").alias("semantic_status"))
    return rows.withColumn("section_id_a", has("added")).withColumn("section_id_b", has("removed"))


@query(f"WITH {_EVENT_DIFFS} SELECT pair_id, " + ", ".join(f"count(*) FILTER (coalesce(nullif(semantic, ''), status) = '{k}') AS {k}" for k in ("modified", "unchanged", "added", "removed", "renumbering_only")) + " FROM d GROUP BY pair_id")
def status_histogram(spark, sf_dir):
    return report.status_histogram(_event_diffs(spark, sf_dir))


@query(
    f"""WITH {_EVENT_DIFFS}, s AS (SELECT pair_id, count(*) FILTER (status <> 'added') AS total_sections_a, count(*) FILTER (status <> 'removed') AS total_sections_b, count(*) FILTER (status NOT IN ('added', 'removed')) AS matched, count(*) FILTER (status = 'removed') AS removed,
 count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status IN ('modified', 'renumbering_only')) AS modified FROM d GROUP BY pair_id),
every AS (SELECT c_custkey AS pair_id FROM customer UNION SELECT pair_id FROM d)
SELECT every.pair_id, coalesce(total_sections_a, 0) AS total_sections_a, coalesce(total_sections_b, 0) AS total_sections_b, coalesce(matched, 0) AS matched, coalesce(removed, 0) AS removed, coalesce(added, 0) AS added, coalesce(unchanged, 0) AS unchanged, coalesce(modified, 0) AS modified,
 round(coalesce(modified, 0) / greatest(1, coalesce(matched, 0)), 4) AS modified_ratio_in_matches, round(coalesce(unchanged, 0) / greatest(1, coalesce(matched, 0)), 4) AS unchanged_ratio_in_matches FROM every LEFT JOIN s ON every.pair_id = s.pair_id"""
)
def diff_totals(spark, sf_dir):
    """Summary and quality ratios of events as diffs, with a row for each customer that has none."""
    d = _event_diffs(spark, sf_dir)
    pairs = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("pair_id")).union(d.select("pair_id"))
    return diffing.quality(diffing.summary(d, pairs))


_TURNS = "c AS (SELECT conv_id AS pair_id, turn AS diff_no, role, coalesce(text, '') AS text, CASE WHEN turn % 2 = 0 THEN 's' || turn ELSE '' END AS sb FROM conversations)"


@query(f"WITH {_TURNS} SELECT pair_id, diff_no, coalesce(nullif(sb, ''), role) AS section_id, CASE WHEN turn3 THEN role ELSE 'T' END AS section_title, sha256(CASE WHEN turn3 THEN text ELSE 'x' || chr(10) || 'y' END) AS before_text, '' AS after_text FROM (SELECT *, diff_no % 3 = 0 AS turn3 FROM c)")
def payloads(spark, sf_dir):
    """What classification reads, from turns as diffs: empty ids, titles and texts count as missing."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    third = F.col("turn") % 3 == 0
    rows = t.select(
        F.col("conv_id").alias("pair_id"), F.col("turn").alias("diff_no"), F.col("role").alias("section_id_a"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("s"), F.col("turn").cast("string"))).otherwise("").alias("section_id_b"),
        F.when(third, F.col("role")).otherwise("T").alias("title_a"), F.lit("").alias("title_b"), F.when(third, F.coalesce("text", F.lit(""))).alias("semantic_text_a"), F.lit("").alias("semantic_text_b"),
        F.when(third, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("section_lines_a"), F.lit(None).cast("array<string>").alias("section_lines_b"),
    )
    p = classify.payload(rows)
    return p.select("pair_id", "diff_no", "section_id", "section_title", F.sha2("before_text", 256).alias("before_text"), "after_text")


_CHUNKS = """w AS (SELECT pair_id, diff_no, diff_no % 4 AS k, string_split(text, ' ') AS x FROM c),
ch AS (SELECT pair_id, diff_no, ['equal', 'replace', 'delete', 'insert'][k + 1] AS tag, CASE WHEN k = 3 THEN [] ELSE x END AS a, CASE k WHEN 2 THEN [] WHEN 0 THEN x ELSE x[3:] END AS b FROM w),
r AS (SELECT pair_id, diff_no, tag, unnest(range(greatest(len(a), len(b), 1))) AS row, a, b FROM ch)"""


def _chunk_rows(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    k, x = F.col("turn") % 4, F.split(F.coalesce("text", F.lit("")), " ")
    none = F.expr("cast(array() as array<string>)")
    tag = F.element_at(F.array(*map(F.lit, ("equal", "replace", "delete", "insert"))), (k + 1).cast("int"))
    a, b = F.when(k == 3, none).otherwise(x), F.when(k == 2, none).when(k == 0, x).otherwise(F.slice(x, F.lit(3), F.size(x)))
    rows = t.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("diff_no"), F.array(F.struct(tag.alias("tag"), a.alias("lines_a"), b.alias("lines_b"))).alias("section_diff"))
    return diffing.row_pairs(rows)


@query(f"WITH {_TURNS}, {_CHUNKS} SELECT pair_id, diff_no, tag, row, coalesce(a[row + 1], '') AS old, coalesce(b[row + 1], '') AS new FROM r")
def row_pairs(spark, sf_dir):
    return _chunk_rows(spark, sf_dir).drop("chunk").withColumn("row", F.col("row").cast("long"))


@query(f"WITH {_TURNS}, {_CHUNKS} SELECT 'left' AS side, pair_id, count(*) FILTER (tag <> 'insert') AS shown, count(*) FILTER (tag NOT IN ('insert', 'equal')) AS changed FROM r GROUP BY pair_id UNION ALL SELECT 'right', pair_id, count(*) FILTER (tag <> 'delete'), count(*) FILTER (tag NOT IN ('delete', 'equal')) FROM r GROUP BY pair_id")
def shown_sides(spark, sf_dir):
    rows = _chunk_rows(spark, sf_dir)
    out = None
    for name, left in (("left", True), ("right", False)):
        shown, changed = diffing.side(rows, left), diffing.side(rows, left, changed_only=True)
        n = shown.withColumn("c", F.lit(0)).unionByName(changed.withColumn("c", F.lit(1))).groupBy("pair_id").agg(F.count_if(F.col("c") == 0).alias("shown"), F.count_if(F.col("c") == 1).alias("changed"))
        n = diffing.of_all(n, rows).select(F.lit(name).alias("side"), "pair_id", "shown", "changed")
        out = n if out is None else out.union(n)
    return out


@query(f"WITH {_TURNS} SELECT pair_id, diff_no || ':' || role || '->' || coalesce(nullif(sb, ''), 'none') AS diff_id, sha256(text) AS text FROM c WHERE pair_id = (SELECT max(pair_id) FROM c) AND diff_id = '0:user->s0'")
def point_lookup(spark, sf_dir):
    """One diff by its id."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = t.select(F.col("conv_id").alias("pair_id"), F.col("turn").alias("diff_no"), F.col("role").alias("section_id_a"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("s"), F.col("turn").cast("string"))).otherwise("").alias("section_id_b"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    return report.point(rows, rows.agg(F.max("pair_id")).first()[0], "0:user->s0").select("pair_id", "diff_id", "text")


@query(
    """WITH x AS (SELECT user_id AS pair_id, event_type AS section_id, arg_max(CASE event_id % 3 WHEN 0 THEN 'editorial' WHEN 1 THEN 'slight' ELSE 'significant' END, event_id) AS label FROM events WHERE event_id % 4 > 0 AND event_type <> 'view' GROUP BY ALL),
d AS (SELECT user_id AS pair_id, event_id AS diff_no, event_type AS a, CASE WHEN event_id % 2 = 0 THEN 'purchase' ELSE '' END AS b FROM events)
SELECT d.pair_id, diff_no || ':' || a || '->' || coalesce(nullif(b, ''), 'none') AS diff_id, coalesce(xb.label, xa.label) AS classification, 'import' AS source FROM d LEFT JOIN x xb ON d.pair_id = xb.pair_id AND d.b = xb.section_id LEFT JOIN x xa ON d.pair_id = xa.pair_id AND d.a = xa.section_id WHERE coalesce(xb.label, xa.label) IS NOT NULL"""
)
def imported_labels(spark, sf_dir):
    """The last label of each section from a log of labels, imported for all diffs: by B's section, else by A's."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 3
    given = e.select(F.col("user_id").alias("pair_id"), F.col("event_id").alias("pos"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("section_id"), F.when(F.col("event_id") % 4 == 0, "").when(k == 0, "editorial").when(k == 1, "slight").otherwise("significant").alias("final_classification"))
    d = e.select(F.col("user_id").alias("pair_id"), F.col("event_id").alias("diff_no"), F.col("event_type").alias("section_id_a"), F.when(F.col("event_id") % 2 == 0, "purchase").otherwise("").alias("section_id_b"))
    return report.imported(d, report.last_labels(given), "import")


@query(
    _with(_lines("a"), f"n AS (SELECT doc_id, page, count(*) FILTER (trim(text) <> '') AS n_lines, sum(length({_collapse('text')})) FILTER (trim(text) <> '')::BIGINT AS n_chars FROM lines_a GROUP BY doc_id, page)")
    + "SELECT (doc_id // 500)::VARCHAR AS volume, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id, page) AS page, n_lines, n_chars FROM n"
)
def pdf_lines(spark, sf_dir):
    """Volumes of 500 documents written as PDF files, read back as spans, and put together as lines."""
    lines, pages = corpus.layout(corpus.documents(spark, sf_dir))
    volume = F.floor(F.col("doc_id") / 500).cast("long").cast("string").alias("volume")
    own = Window.partitionBy("volume").orderBy("doc_id", "page")
    lines = lines.select(volume, "doc_id", "page", "line_no", "x0", "y0", "text").withColumn("no", F.dense_rank().over(own)).withColumn("_k", F.row_number().over(Window.partitionBy("volume").orderBy("doc_id", "page", "line_no")))

    def files(batches):
        every = (row for batch in batches for row in zip(*(batch[c].tolist() for c in ("volume", "no", "x0", "y0", "text")), strict=True))
        for name, rows in itertools.groupby(every, key=lambda row: row[0]):
            made = [(corpus.HEIGHT, [row[2:] for row in page]) for _, page in itertools.groupby(rows, key=lambda row: row[1])]
            yield pd.DataFrame({"name": [f"{name}.pdf"], "content": [pdf.made(made)]})

    path = f"{shared_dir(spark)}/pdf-{uuid.uuid4().hex}"
    write_files(lines.mapInPandas(files, "name string, content binary"), path)
    got = readers.extract(spark, path, "pdf")[0]
    return got.groupBy(F.col("doc_id").alias("volume"), F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query(
    f"""WITH p AS (SELECT DISTINCT doc_id, k // 4 + 1 AS page FROM (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents)),
f AS (SELECT *, CASE (doc_id + 7 * page) % 5 WHEN 2 THEN '{_NOISY[0]}' WHEN 3 THEN '{_NOISY[1]}' WHEN 4 THEN '{_NOISY[2]}' ELSE '{_CLEAN}' END AS text FROM p),
c AS (SELECT *, arg_min(text, page) OVER (PARTITION BY doc_id) AS leader, count(*) OVER (PARTITION BY doc_id) AS n_pages, count(*) OVER (PARTITION BY doc_id, text) AS n FROM f),
-- one changed character is close, two are not: what does not join the first form stands alone, but for the clean form
k AS (SELECT *, CASE WHEN n_pages = 1 THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, CASE WHEN leader = '{_CLEAN}' THEN leader WHEN text = '{_CLEAN}' THEN leader ELSE text END) END AS pages FROM c)
SELECT doc_id, page, text, CASE WHEN n / n_pages >= 0.6 THEN 'repeat' ELSE 'cluster' END AS reason FROM k WHERE n / n_pages >= 0.6 OR pages / n_pages >= 0.6"""
)
def noisy_furniture(spark, sf_dir):
    """Footers of which some have one character misread: clusters where equality finds none."""
    pages = corpus.layout(corpus.documents(spark, sf_dir))[1]
    k = F.pmod(F.col("doc_id") + 7 * F.col("page"), F.lit(5))
    text = F.when(k == 2, _NOISY[0]).when(k == 3, _NOISY[1]).when(k == 4, _NOISY[2]).otherwise(_CLEAN)
    lines = pages.select("doc_id", F.col("page").cast("long").alias("line_no"), "page", F.lit(50.0).alias("x0"), F.lit(760.0).alias("y0"), F.lit(200.0).alias("x1"), F.lit(780.0).alias("y1"), text.alias("text"))
    return layout.removable(lines, pages)


@query(
    _with(
        "e AS (SELECT doc_id, line_no, text, line_no // 6 + 1 AS page, (doc_id + line_no) % 9 <> 0 AND doc_id % 3 > 0 AS has, CASE WHEN (doc_id + line_no) % 4 > 0 THEN 700 + line_no % 5 END AS h FROM body_a WHERE trim(text) <> '')",
        "o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) - 1 AS row FROM e)",
        "p AS (SELECT doc_id, page, greatest(max(CASE WHEN row = 0 THEN CASE WHEN has AND h IS NOT NULL THEN h ELSE 1000 END END), max(CASE WHEN has THEN h END)) AS height FROM o GROUP BY ALL)",
    )
    + f"SELECT o.doc_id, count(*) AS n_lines, sum(CASE WHEN has THEN 10.0 * line_no ELSE row END) AS y0, sum(CASE WHEN has THEN 50.0 ELSE length({_collapse('text')}) END) AS x1, avg(CASE WHEN has THEN 1.0 ELSE 0.0 END) >= 0.8 AS reliable, any_value(s.height) AS height FROM o JOIN (SELECT doc_id, sum(height)::DOUBLE AS height FROM p GROUP BY doc_id) s ON o.doc_id = s.doc_id GROUP BY o.doc_id"
)
def element_lines(spark, sf_dir):
    """Lines as elements, some without coordinates or height, turned back into lines and pages."""
    body = corpus.version(corpus.body_lines(corpus.documents(spark, sf_dir)), "a")
    k, n = F.col("doc_id") + F.col("line_no"), F.col("line_no").cast("double")
    box = F.array(*[F.struct(F.lit(x).alias("x"), (10 * n + y).alias("y")) for x, y in ((50.0, 0), (5.0, 8))])
    e = body.select("doc_id", F.col("line_no").alias("element_no"), (F.floor(F.col("line_no") / 6) + 1).cast("int").alias("page"), "text", F.when((k % 9 != 0) & (F.col("doc_id") % 3 > 0), box).alias("points"), F.when(k % 4 > 0, (700 + F.col("line_no") % 5).cast("double")).alias("height"))
    lines, pages = layout.lines_from_elements(e)
    heights = pages.groupBy("doc_id").agg(F.sum("height").alias("height"), F.first("reliable").alias("reliable"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum("y0").alias("y0"), F.sum("x1").alias("x1")).join(heights, "doc_id").select("doc_id", "n_lines", "y0", "x1", "reliable", "height")


# --- sinks, read back --------------------------------------------------------------------


def _turn_diffs(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    even = F.col("turn") % 2 == 0
    return t.select(
        F.col("conv_id").cast("string").alias("pair_id"), F.col("turn").alias("diff_no"), F.col("role").alias("section_id_a"), F.when(even, F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("section_id_b"), F.lit("2. T").alias("title_a"), F.lit("").alias("title_b"),
        F.coalesce("text", F.lit("")).alias("semantic_text_a"), F.lit(None).cast("string").alias("semantic_text_b"), F.lit(None).cast("array<string>").alias("section_lines_a"), F.array(F.lit('say "x"'), F.lit("y, z")).alias("section_lines_b"),
        (F.col("turn") / 4).alias("score"), F.col("turn").cast("int").alias("start_page_a"), F.lit(None).cast("int").alias("start_page_b"), F.when(even, "modified").otherwise("unchanged").alias("status"),
    )


@query("SELECT conv_id::VARCHAR AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS diff_no, role AS section_id_a, CASE WHEN turn % 2 = 0 THEN 's' || turn END AS section_id_b, sha256(coalesce(text, '')) AS text, turn / 4 AS match_score, turn::INTEGER AS page_no_in_a, true AS no_page_b, CASE WHEN turn % 2 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM conversations")
def stored_reports(spark, sf_dir):
    """Reports of all conversations, written as JSON and read back."""
    diffs = _turn_diffs(spark, sf_dir)
    path = f"{shared_dir(spark)}/reports-{uuid.uuid4().hex}"
    writers.write_json(diffs, diffing.summary(diffs), path)
    return readers.reports(spark, path).select("pair_id", "diff_no", "section_id_a", "section_id_b", F.sha2("semantic_text_a", 256).alias("text"), "match_score", "page_no_in_a", F.col("page_no_in_b").isNull().alias("no_page_b"), "status")


@query("""SELECT conv_id::VARCHAR AS pair_id, turn::VARCHAR AS page_number_file_a, '2' AS section_number_file_a, sha256(CASE WHEN trim(coalesce(text, '')) = '' THEN '2. T' ELSE text END) AS text_file_a, sha256('say "x"' || chr(10) || 'y, z') AS text_file_b, turn / 4 AS diff_score FROM conversations""")
def stored_exports(spark, sf_dir):
    """The tabular export as CSV, with quotes, commas and line breaks in its cells, read back."""
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    writers.write_csv(report.export_rows(_turn_diffs(spark, sf_dir)), path)
    kinds = ", ".join(f"{c} {'double' if c == 'diff_score' else 'string'}" for c in [*writers.EXPORT, "pair_id"])
    rows = spark.read.schema(kinds).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select("pair_id", "page_number_file_a", "section_number_file_a", F.sha2("text_file_a", 256).alias("text_file_a"), F.sha2("text_file_b", 256).alias("text_file_b"), "diff_score")


@query("SELECT user_id AS pair_id, event_type AS diff_id, max(event_id) AS event_id, count(*) AS seq FROM events WHERE event_id % 3 = (SELECT max(e.event_id % 3) FROM events e WHERE e.user_id = events.user_id AND e.event_type = events.event_type) GROUP BY ALL")
def stored_annotations(spark, sf_dir):
    """An append log written in three calls, each with its own entries of the same moment: the last call with a key wins."""
    path = f"{shared_dir(spark)}/annotations-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("pair_id"), F.col("event_type").alias("diff_id"), "event_id", F.lit("2026-01-01").cast("timestamp").alias("updated_at"))
    for k in range(3):
        writers.append_log(e.filter(F.col("event_id") % 3 == k), path)
    writers.compact_log(spark, path)
    last = report.latest(writers.read_log(spark, path), ["pair_id", "diff_id"]).drop("call", "batch")
    size = e.groupBy("pair_id", "diff_id", (F.col("event_id") % 3).alias("k")).agg(F.count("*").alias("seq"))
    size = size.groupBy("pair_id", "diff_id").agg(F.max_by("seq", "k").alias("seq"))
    return last.drop("seq").join(size, ["pair_id", "diff_id"]).select("pair_id", "diff_id", "event_id", "seq")
