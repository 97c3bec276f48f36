"""Queries over documents, conversations and pages: report rules, header years, grids and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.functions import text as X
from tallymark.operators import ordered as O, select as S
from tallymark.operators.terms import term_counts, titled
from tallymark.plans import standins
from tallymark.plans.registry import query, table
from tallymark.sources import grids, reports

TITLES = {"Licensed under": "a", "Released under": "b", "The and": "c"}


@query("""select doc_id, (i - 1)::integer as line_no, string_split(text, chr(10))[i] as line
from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return reports.report_lines(docs).select("doc_id", "line_no", "line")


LINES_SQL = """lines as (
  select doc_id, i as line_no, string_split(text, chr(10))[i] as line
  from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))"""


@query(f"""with {LINES_SQL},
marked as (
  select *, length(line) < 9 as is_end from lines),
parts as (select *, sum(is_end::integer) over (partition by doc_id order by line_no) as part from marked),
titled as (
  select *, not is_end and regexp_matches(line, '(?i)l *i *c *e *n *s *e *d *u *n *d *e *r|r *e *l *e *a *s *e *d *u *n *d *e *r|t *h *e *a *n *d')
            and not regexp_matches(line, '(?i)u *p *d *a *t *e *d|s *t *a *t *i *s *t *i *c *s|s *h *o *w *n') as is_title
  from parts),
starts as (select doc_id, part, min(line_no) as start_no from titled where is_title group by all),
body as (
  select t.doc_id, s.start_no, t.line_no, t.line from titled t join starts s using (doc_id, part)
  where t.line_no >= s.start_no and not t.is_end),
heads as (select doc_id, start_no, lower(replace(line, ' ', '')) as key from body where line_no = start_no)
select b.doc_id,
       case when contains(key, 'licensedunder') then 'Licensed under' when contains(key, 'releasedunder') then 'Released under' else 'The and' end as title,
       (b.line_no - b.start_no - 1)::integer as row_no, b.line
from body b join heads h using (doc_id, start_no) where b.line_no > b.start_no""")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Titled tables of every document; lines of less than nine characters stand for blank lines."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.regexp_replace("text", r"(?m)^[^\n]{0,8}$", "").alias("text")
    )
    found = reports.report_tables(docs, TITLES).filter("body <> ''")
    return found.select("doc_id", "title", F.posexplode_outer(F.split("body", "\n")).alias("row_no", "line"))


@query(f"""with {LINES_SQL},
kept as (select * from lines where line <> ''),
joined as (
  select doc_id, line_no, line,
         coalesce(lag(ends_open) over (partition by doc_id order by line_no), false) as continues
  from (select *, line like '%,' or line like '%a.' as ends_open from kept)),
grouped as (select *, sum((not continues)::integer) over (partition by doc_id order by line_no) as grp from joined),
whole as (select doc_id, grp, string_agg(line, ' ' order by line_no) as line from grouped group by all),
carried as (
  select doc_id, grp, line,
         last_value(case when regexp_matches(line, '^(The|And|In|Of|To) ') then split_part(line, ' ', 1) end ignore nulls)
           over (partition by doc_id order by grp) as section_word
  from whole)
select doc_id, section_word, line, count(*)::bigint as n from carried where section_word is not null group by all""")
def report_line_join(spark: SparkSession, d: str) -> DataFrame:
    """Broken lines joined, then the word of the last section line carried down; no window needed."""
    tidy = F.btrim(F.regexp_replace("text", r"\n\n+", "\n"), F.lit("\n"))
    # the newline first, then a look back: the pattern then gives up at once on every other character
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace(tidy, r"\n(?<=(?:,|a\.)\n)", " ").alias("text"))
    sections = docs.select("doc_id", F.explode_outer(reports.blocks(F.col("text"), "(?:The|And|In|Of|To) ")).alias("block"))
    word = F.regexp_extract("block", "^(The|And|In|Of|To) ", 1)
    # word and lines first: beside the explode the whole block would be carried along with every line
    cut = sections.select("doc_id", word.alias("section_word"), F.split("block", "\n").alias("lines"))
    lines = cut.select("doc_id", "section_word", F.explode_outer("lines").alias("line"))
    return lines.filter("section_word <> ''").groupBy("doc_id", "section_word", "line").agg(F.count("*").alias("n"))


@query(f"""with {LINES_SQL}
select doc_id, line_no::integer - 1 as line_no, replace(regexp_extract(line, '^([^0-9-]*)', 1), ' ', '') as label,
       trim(regexp_replace(regexp_extract(line, '^[^0-9-]*(.*)$', 1), ' {{2,}}', ' ', 'g')) as tail
from lines where regexp_matches(line, '[0-9]')""")
def label_number_split(spark: SparkSession, d: str) -> DataFrame:
    lines = reports.report_lines(table(spark, d, "documents").select("doc_id", "text")).filter(F.col("line").rlike("[0-9]"))
    return lines.select(
        "doc_id", "line_no", X.label_part(F.col("line")).alias("label"), F.array_join(X.value_parts(F.col("line")), " ").alias("tail")
    )


@query("""select p_partkey, array_to_string(regexp_extract_all(
  p_type || 'Furanyl' || upper(left(p_name, 1)) || substr(p_name, 2) || 'Opioid(Unknown)', '(Opioid\\(Unknown\\)|FuranylFentanyl|FuranylUF-17|[A-Z][a-z0-9\\-\\(\\)\\*]*)', 1), '|') as tokens
from part""")
def capital_token_split(spark: SparkSession, d: str) -> DataFrame:
    joined = F.concat("p_type", F.lit("Furanyl"), F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"), F.lit("Opioid(Unknown)"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.capital_tokens(joined), "|").alias("tokens"))


HEADERS_SQL = """with headers as (
  select o_orderpriority as sheet, ((year(o_orderdate) - 1990) * 12 + month(o_orderdate))::integer as col_no,
         strftime(min(o_orderdate), '%b') as header
  from orders group by all),
base as (select year(max(o_orderdate))::integer as base_year, year(min(o_orderdate))::integer as first_year from orders)"""


def _headers(spark: SparkSession, d: str) -> DataFrame:
    """Month headers of one sheet per order priority, in calendar order."""
    day = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("sheet"), ((F.year(day) - 1990) * 12 + F.month(day)).alias("col_no")
    ).agg(F.date_format(F.min(day), "MMM").alias("header"))


def _edge_year(spark: SparkSession, d: str, edge):
    return F.year(table(spark, d, "orders").agg(edge("o_orderdate")).scalar())


@query(f"""{HEADERS_SQL}
select sheet, col_no, header,
       (base_year - sum((header = 'Dec')::integer) over (partition by sheet order by col_no desc))::integer as year
from headers cross join base""")
def header_year_inference(spark: SparkSession, d: str) -> DataFrame:
    return O.month_header_years(_headers(spark, d), ["sheet"], _edge_year(spark, d, F.max))


@query(f"""{HEADERS_SQL},
newest as (select sheet, arg_max(header, col_no) as label from headers group by sheet)
select sheet, col_no, header,
       (base_year + 1 - sum((header = label)::integer) over (partition by sheet order by col_no desc))::integer as year
from headers join newest using (sheet) cross join base""")
def header_cycle_years(spark: SparkSession, d: str) -> DataFrame:
    return O.cycle_header_years(_headers(spark, d), ["sheet"], _edge_year(spark, d, F.max))


@query(f"""{HEADERS_SQL}
select sheet, col_no, header,
       (first_year - 1 + sum((header = 'Jan')::integer) over (partition by sheet order by col_no))::integer as year
from headers cross join base""")
def header_marker_years(spark: SparkSession, d: str) -> DataFrame:
    return O.marker_header_years(_headers(spark, d), ["sheet"], _edge_year(spark, d, F.min), "Jan")


@query("""select conv_id, turn, last_value(case when turn % 2 = 0 then text end ignore nulls)
  over (partition by conv_id order by turn) as text
from conversations""")
def forward_fill(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).alias("text")
    )
    return O.carry_forward(turns, ["conv_id"], "turn", ["text"])


@query("""with l as (select page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) as a from pages)
select page_id, 0 as grid_no, (i - 1)::integer as row_no, 0 as cell_no, 'gridcell' as role, a[i] as text
from (select page_id, a, unnest(range(1, len(a) + 1)) as i from l)""")
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return grids.read_grid_cells(table(spark, d, "pages"))


@query("""with l as (select page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) as a from pages)
select page_id, a[i] as link from (select page_id, a, unnest(range(1, len(a) + 1)) as i from l)""")
def grid_records(spark: SparkSession, d: str) -> DataFrame:
    return grids.grid_records(grids.read_grid_cells(table(spark, d, "pages")), ["link"]).select("page_id", "link")


@query("""select p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') as title,
       upper(p_type[1]) || lower(p_type[2:]) as sentence,
       replace('Samples in the replace_with_category category', 'replace_with_category', p_type) as filled,
       replace(p_name, ' ', '') as squeezed
from part""")
def display_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", X.title_case(F.col("p_name")).alias("title"), X.sentence_case(F.col("p_type")).alias("sentence"),
        X.fill_template(F.lit("Samples in the replace_with_category category"), "replace_with_category", F.col("p_type")).alias("filled"),
        X.no_blanks(F.col("p_name")).alias("squeezed"),
    )


@query("""with n as (select conv_id, turn, text, max(turn) over (partition by conv_id) as last from conversations)
select conv_id, turn, text from n where turn >= 1 and turn <= last - 1""")
def trimmed_rows(spark: SparkSession, d: str) -> DataFrame:
    """Title and footer rows cut off every table (a conversation is a table of turns)."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return S.trim_rows(turns, ["conv_id"], "turn", 1, 1)


TERMS_SQL = """terms as (
  select distinct word as term from (select unnest(string_split_regex(lower(text), '[^a-z]+')) as word from benchmark) where length(word) >= 5)"""


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of five letters and more of the benchmark, as a table of terms."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")
    return table(spark, d, "benchmark").select(words).filter(F.length("term") >= 5)


@query(f"""with {TERMS_SQL},
docs as (select coalesce(lang, 'und') as lang, lower(coalesce(text, '')) as text from documents),
totals as (select lang, count(*)::bigint as total from docs group by lang),
c as (select lang, term, count(*)::bigint as n from docs join terms on contains(text, term) group by all)
select lang, term, n, total, round_even(n::double / total * 100.0, 2) as percent from c join totals using (lang)""")
def term_counts_from_table(spark: SparkSession, d: str) -> DataFrame:
    """Documents per language that mention each term of a table."""
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return term_counts(docs, ["lang"], _terms(spark, d), "text")


NAMES_SQL = """terms as (
  select distinct split_part(p_name, ' ', 2) as term from part where p_retailprice >= (select max(p_retailprice) from part) - 1)"""


@query(f"with {NAMES_SQL} select p_partkey, p_name from part where exists (select 1 from terms where contains(p_name, term))")
def titles_by_term_table(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose title contains a term of a table (here: last words of the names with a top price)."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice")
    top = parts.agg(F.max("p_retailprice")).scalar()
    terms = parts.filter(F.col("p_retailprice") >= top - 1).select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term"))
    return titled(parts, terms, "p_name").select("p_partkey", "p_name")
