"""Rows to notes, notes to pieces, grids to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.functions import text as X
from rowscribe.operators import generate as M
from rowscribe.operators import linearize as G
from rowscribe.operators import sampling as K
from rowscribe.operators import serialize as S
from rowscribe.operators.template import NoteTemplate
from rowscribe.plans.registry import query, sql_clean, sql_hash, sql_hash_int, table, text_rows
from rowscribe.session import dealt_out

SEED = 7
SEGMENTS = {
    "AUTOMOBILE": "cars",
    "BUILDING": "building trade",
    "FURNITURE": "furniture",
    "HOUSEHOLD": "household goods",
    "MACHINERY": "machines",
}
SEGMENT_SQL = (
    "CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())
    + " ELSE error('no phrase') END"
)
CUSTOMER = (("n_name", "Nation"), ("c_mktsegment", "Market segment"), ("c_acctbal", "Balance"))
CUSTOMER_FORMATS = {"c_mktsegment": X.phrases(SEGMENTS), "c_acctbal": X.fixed_text(2)}

PART = (
    ("p_name", "Name"),
    ("p_brand", "Brand"),
    ("p_type", "Type"),
    ("p_size", "Size"),
    ("p_retailprice", "Retail price"),
)
PART_FORMATS = {"p_size": X.integer_text, "p_retailprice": X.fixed_text(2)}
PART_LIST_SQL = (
    "'- Name: ' || p_name || chr(10) || '- Brand: ' || p_brand || chr(10) || '- Type: ' || p_type "
    "|| chr(10) || '- Size: ' || p_size || chr(10) || '- Retail price: ' "
    "|| printf('%.2f', p_retailprice)"
)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    columns = ("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return text_rows(spark, sf_dir, "customer", *columns).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_rows(spark, sf_dir, "part", "p_partkey", *[c for c, _ in PART])


def part_notes(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """The list notes; ``dealt`` for work on them that takes much longer than moving rows."""
    template = S.feature_template(PART, "list", PART_FORMATS)
    rows = parts(spark, sf_dir)
    rows = dealt_out(rows, "p_partkey") if dealt else rows
    return S.serialize(rows, template).select("p_partkey", "note")


@query(
    "serialize_sentence",
    f"""SELECT c_custkey, {sql_clean(f"'The Nation is ' || n_name || '. The Market segment is ' || {SEGMENT_SQL} || '. The Balance is ' || printf('%.2f', c_acctbal) || '.'")} AS note
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def serialize_sentence(spark, sf_dir):
    template = S.feature_template(CUSTOMER, "text", CUSTOMER_FORMATS)
    return S.serialize(customers(spark, sf_dir), template).select("c_custkey", "note")


@query("serialize_list", f"SELECT p_partkey, {sql_clean(PART_LIST_SQL)} AS note FROM part")
def serialize_list(spark, sf_dir):
    return part_notes(spark, sf_dir)


@query(
    "serialize_values",
    f"""SELECT p_partkey, {sql_clean("p_name || chr(10) || p_brand || chr(10) || p_type || chr(10) || p_size || chr(10) || printf('%.2f', p_retailprice)")} AS note FROM part""",
)
def serialize_values(spark, sf_dir):
    template = S.feature_template(PART, "values", PART_FORMATS)
    return S.serialize(parts(spark, sf_dir), template).select("p_partkey", "note")


@query(
    "serialize_permuted",
    f"""SELECT s_suppkey, {sql_clean("'- Name: ' || printf('%.2f', s_acctbal) || chr(10) || '- Nation: ' || s_name || chr(10) || '- Balance: ' || n_name")} AS note
    FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def serialize_permuted(spark, sf_dir):
    features = (("s_name", "Name"), ("n_name", "Nation"), ("s_acctbal", "Balance"))
    template = S.feature_template(
        features, "permuted", {"s_acctbal": X.fixed_text(2)}, permutation=(3, 1, 2)
    )
    rows = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return S.serialize(rows, template).select("s_suppkey", "note")


def _decimals_sql(digits: int, number: str) -> str:
    return f"array_to_string([printf('%.{digits}f', {number}) FOR x IN embedding], ' ')"


@query(
    "decimal_text",
    f"""SELECT vec_id, {', '.join(f"{_decimals_sql(d, 'x::DOUBLE')} AS text_{d}" for d in range(1, 6))},
        {_decimals_sql(1, 'floor(x::DOUBLE * 16) / 16')} AS ties_1, {_decimals_sql(3, 'floor(x::DOUBLE * 16) / 16')} AS ties_3
    FROM embeddings""",
)
def decimal_text(spark, sf_dir):
    """Every component as text with one to five decimals, and multiples of 1/16, of which many are ties."""

    def joined(digits, number):
        return F.array_join(F.transform("embedding", lambda x: X.fixed_text(digits)(number(x.cast("double")))), " ")

    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        *(joined(d, lambda x: x).alias(f"text_{d}") for d in range(1, 6)),
        *(joined(d, lambda x: F.floor(x * 16) / 16).alias(f"ties_{d}") for d in (1, 3)),
    )


def _exchange_sql(column: str) -> str:
    h = sql_hash(SEED, "'exchange'", f"'{column}'", "v")
    return f"""r_{column} AS (
        SELECT v, row_number() OVER (ORDER BY {h}, v) AS k, count(*) OVER () AS n
        FROM (SELECT DISTINCT {column} AS v FROM part)),
    m_{column} AS (
        SELECT a.v AS old_v, b.v AS new_v FROM r_{column} a JOIN r_{column} b ON b.k = a.k % a.n + 1)"""


@query(
    "serialize_shuffled_categorical",
    f"""WITH {_exchange_sql('p_brand')}, {_exchange_sql('p_type')},
    x AS (SELECT p_partkey, p_name, b.new_v AS p_brand, t.new_v AS p_type, p_size, p_retailprice
          FROM part JOIN m_p_brand b ON p_brand = b.old_v JOIN m_p_type t ON p_type = t.old_v)
    SELECT p_partkey, {sql_clean(PART_LIST_SQL)} AS note FROM x""",
)
def serialize_shuffled_categorical(spark, sf_dir):
    rows = K.exchange_categories(parts(spark, sf_dir), ["p_brand", "p_type"], SEED)
    template = S.feature_template(PART, "list", PART_FORMATS)
    return S.serialize(rows, template).select("p_partkey", "note")


def _bins_sql(column: str) -> str:
    c = column
    return f"""s_{c} AS MATERIALIZED (
        SELECT p_partkey, {c} AS v, row_number() OVER (ORDER BY {c}, p_partkey) - 1 AS pos,
               count(*) OVER () AS n FROM part),
    e_{c} AS MATERIALIZED (
        SELECT b, floor(b * (n / 10.0::DOUBLE))::BIGINT AS low,
               floor((b + 1) * (n / 10.0::DOUBLE))::BIGINT AS high,
               row_number() OVER (ORDER BY {sql_hash(SEED, "'bins'", f"'{c}'", 'b')}, b) AS k
        FROM (SELECT DISTINCT n FROM s_{c}), range(10) t(b)),
    f_{c} AS MATERIALIZED (
        SELECT e.b, lo.v AS first_v, hi.v AS last_v, t.low, t.high
        FROM e_{c} e JOIN s_{c} lo ON lo.pos = e.low JOIN s_{c} hi ON hi.pos = e.high - 1
        JOIN e_{c} t ON t.k = e.k % 10 + 1),
    g_{c} AS MATERIALIZED (
        SELECT p_partkey, arg_min(low, b) AS low, arg_min(high, b) AS high
        FROM s_{c} JOIN f_{c} ON v BETWEEN first_v AND last_v GROUP BY p_partkey),
    n_{c} AS MATERIALIZED (
        SELECT g.p_partkey, m.v AS {c} FROM g_{c} g JOIN s_{c} m
        ON m.pos = g.low + {sql_hash_int(SEED, "'member'", f"'{c}'", 'g.p_partkey')} % (g.high - g.low))"""


@query(
    "serialize_shuffled_numeric",
    f"""WITH {_bins_sql('p_size')}, {_bins_sql('p_retailprice')},
    x AS (SELECT p.p_partkey, p_name, p_brand, p_type, a.p_size, b.p_retailprice
          FROM part p JOIN n_p_size a ON a.p_partkey = p.p_partkey
          JOIN n_p_retailprice b ON b.p_partkey = p.p_partkey)
    SELECT p_partkey, {sql_clean(PART_LIST_SQL)} AS note FROM x""",
)
def serialize_shuffled_numeric(spark, sf_dir):
    rows = K.exchange_numbers(
        parts(spark, sf_dir), "p_partkey", ["p_size", "p_retailprice"], SEED
    )
    template = S.feature_template(PART, "list", PART_FORMATS)
    return S.serialize(rows, template).select("p_partkey", "note")


@query(
    "serialize_dates",
    f"""SELECT o_orderkey, {sql_clean("'On ' || strftime(o_orderdate, '%B %-d, %Y') || ' an order was placed' || CASE WHEN o_totalprice > 100000 THEN ' for ' || printf('%.2f', o_totalprice) || ' dollars' ELSE '' END || ' with ' || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'no' ELSE upper(o_orderpriority) END || ' priority. It is ' || date_diff('day', o_orderdate::DATE, DATE '2005-01-01') || ' days old .'")} AS note FROM orders""",
)
def serialize_dates(spark, sf_dir):
    template = NoteTemplate(
        "On ${o_orderdate} an order was placed${o_totalprice} with ${o_orderpriority} priority. "
        "It is ${age} days old .",
        prefixes={"o_totalprice": " for "},
        suffixes={"o_totalprice": " dollars"},
        defaults={"o_orderpriority": "no"},
        pre={
            "o_orderpriority": X.absent_if("4-NOT SPECIFIED"),
            "o_totalprice": lambda c: F.when(c > 100000, X.fixed_text(2)(c)),
        },
        post={"o_orderpriority": F.upper},
    )
    columns = ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    rows = text_rows(spark, sf_dir, "orders", *columns).withColumn(
        "age", F.lit("2005-01-01").cast("date") - F.col("o_orderdate").cast("date")
    )
    return S.serialize(rows, template).select("o_orderkey", "note")


STATUS = {"F": "finished", "O": "open", "P": "pending"}


@query(
    "field_mapping_strict",
    """SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending'
             ELSE error('no phrase') END AS status,
        CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS done,
        CASE WHEN o_custkey % 10 = 0 THEN 'house account' ELSE (o_custkey % 10)::VARCHAR END AS account,
        trunc(o_totalprice)::BIGINT::VARCHAR AS whole_price
    FROM orders""",
)
def field_mapping_strict(spark, sf_dir):
    last_digit = F.col("o_custkey") % 10
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        X.phrases(STATUS)(F.col("o_orderstatus")).alias("status"),
        X.two_way("F", "yes", "no")(F.col("o_orderstatus")).alias("done"),
        X.sentinel(0, "house account", X.integer_text)(last_digit).alias("account"),
        X.integer_text(F.col("o_totalprice")).alias("whole_price"),
    )


@query(
    "field_mapping_lenient",
    """SELECT o_orderkey,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' END AS known_only,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS kept,
        CASE WHEN lower(o_orderpriority) <> '5-low' THEN o_orderpriority END AS no_low,
        CASE WHEN lower(o_orderpriority) LIKE '1-%' THEN 'first' ELSE lower(o_orderpriority) END AS prefixed
    FROM orders""",
)
def field_mapping_lenient(spark, sf_dir):
    priority = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        X.phrases({"1-URGENT": "urgent", "2-HIGH": "high"}, "null")(priority).alias("known_only"),
        X.phrases({"1-URGENT": "urgent"}, "keep")(priority).alias("kept"),
        X.absent_if("5-LOW")(priority).alias("no_low"),
        F.when(F.lower(priority).startswith("1-"), "first")
        .otherwise(F.lower(priority))
        .alias("prefixed"),
    )


@query(
    "clean_text",
    f"""SELECT doc_id, md5(note) AS note_md5, length(note)::BIGINT AS note_chars
    FROM (SELECT doc_id, {sql_clean('text')} AS note FROM documents)""",
)
def clean_text(spark, sf_dir):
    documents = text_rows(spark, sf_dir, "documents", "doc_id", "text")
    return X.clean_notes(documents, F.col("text"), "note").select(
        "doc_id",
        F.md5("note").alias("note_md5"),
        F.length("note").cast("bigint").alias("note_chars"),
    )


def _shout(texts):
    """A stand-in for a text model: marks around the upper-case request."""
    return [f"<pad> {t.strip().upper()}</s>" for t in texts]


def _echo(texts):
    """A stand-in that answers with the value below the header."""
    values = [t.split("<highlighted_cell> ")[2].split(" <col_header>")[0] for t in texts]
    return [f"{t}> {v} </s>" for t, v in zip(texts, values)]


@query(
    "notes_from_chunks",
    """SELECT p_partkey, upper('Write this information as a sentence: Name: ' || p_name || ', Brand: ' || p_brand || '. '
        || 'Write this information as a sentence: Type: ' || p_type || ', Size: ' || p_size || '. '
        || 'Write this information as a sentence: Retail price: ' || printf('%.2f', p_retailprice) || '.') AS note FROM part""",
)
def notes_from_chunks(spark, sf_dir):
    """The way of a note through an outside model, here a stand-in."""
    notes = part_notes(spark, sf_dir, dealt=True)
    return M.notes_from_chunks(notes, "note", ["p_partkey"], lambda: _shout)


@query(
    "notes_from_pairs",
    """SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size || ' '
        || printf('%.2f', p_retailprice) AS note FROM part""",
)
def notes_from_pairs(spark, sf_dir):
    notes = part_notes(spark, sf_dir, dealt=True)
    return M.notes_from_pairs(notes, "note", ["p_partkey"], lambda: _echo)


LINE = r"^- (.*):([^:]*)$"


@query(
    "name_value_extract",
    f"""WITH n AS (SELECT p_partkey, {sql_clean(PART_LIST_SQL)} AS note FROM part),
    l AS (SELECT p_partkey, unnest(string_split(note, chr(10))) AS line,
                 generate_subscripts(string_split(note, chr(10)), 1) - 1 AS pos FROM n)
    SELECT p_partkey, pos::BIGINT AS pos, trim(regexp_extract(line, '{LINE}', 1)) AS name,
           trim(regexp_extract(line, '{LINE}', 2)) AS value FROM l""",
)
def name_value_extract(spark, sf_dir):
    pairs = S.explode_pairs(part_notes(spark, sf_dir), "note", ["p_partkey"])
    return pairs.withColumn("pos", F.col("pos").cast("bigint"))


_CHUNKS_SQL = """c AS (
    SELECT p_partkey, unnest([0, 1, 2]) AS pos,
           unnest(['Name: ' || p_name || ', Brand: ' || p_brand,
                   'Type: ' || p_type || ', Size: ' || p_size,
                   'Retail price: ' || printf('%.2f', p_retailprice)]) AS body FROM part)"""


@query(
    "chunk_pairs",
    f"""WITH {_CHUNKS_SQL} SELECT p_partkey, pos::BIGINT AS pos,
        'Write this information as a sentence: ' || body || '. ' || chr(10) AS chunk FROM c""",
)
def chunk_pairs(spark, sf_dir):
    chunks = S.explode_chunks(part_notes(spark, sf_dir), "note", ["p_partkey"])
    return chunks.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "regroup_chunks",
    f"""WITH {_CHUNKS_SQL} SELECT p_partkey, string_agg(upper('Write this information as a sentence: '
        || body || '. ' || chr(10)), ' ' ORDER BY pos) AS note FROM c GROUP BY p_partkey""",
)
def regroup_chunks(spark, sf_dir):
    chunks = S.explode_chunks(part_notes(spark, sf_dir), "note", ["p_partkey"])
    spoken = chunks.withColumn("chunk", F.upper("chunk"))
    return S.regroup(spoken, ["p_partkey"], "pos", "chunk")


@query(
    "generated_cleanup",
    """SELECT p_partkey, 'the ' || p_name || ' by ' || p_brand AS tagged,
        p_name || ' is ' || lower(p_type) AS marked FROM part""",
)
def generated_cleanup(spark, sf_dir):
    out = F.concat(F.lit("<s> a > <x> the "), "p_name", F.lit("\nby "), "p_brand", F.lit("\n</s>"))
    marked = F.concat(F.lit("<pad> "), "p_name", F.lit(" is "), F.lower("p_type"), F.lit("</s>"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        S.generated_between_tags(out).alias("tagged"),
        S.generated_inside_marks(marked).alias("marked"),
    )


@query(
    "linearize_table",
    """WITH f AS (SELECT n_nationkey, unnest([0, 1]) AS pos, unnest(['Nation', 'Region']) AS name,
                        unnest([n_name, r_name]) AS value
                 FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT n_nationkey, pos::BIGINT AS pos,
        '<s><table> <row> <highlighted_cell> ' || name || ' </highlighted_cell> </row> <row> '
        || '<highlighted_cell> ' || value || ' <col_header> ' || name || ' </col_header> '
        || '</highlighted_cell> </row> </table>' || chr(10) || chr(10) AS linearized FROM f""",
)
def linearize_table(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    template = S.feature_template((("n_name", "Nation"), ("r_name", "Region")), "list")
    pairs = S.explode_pairs(S.serialize(rows, template), "note", ["n_nationkey"])
    grid = G.feature_grid(F.col("name"), F.col("value"))
    marked = F.array(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(0)))
    return pairs.select(
        "n_nationkey",
        F.col("pos").cast("bigint").alias("pos"),
        G.linearize(grid, marked, F.lit(""), F.lit("")).alias("linearized"),
    )


def _cell(value, span: int = 1, header: bool = False):
    return F.struct(
        F.lit(span).alias("column_span"),
        F.lit(header).alias("is_header"),
        F.lit(1).alias("row_span"),
        value.alias("value"),
    )


@query(
    "linearize_spans",
    """SELECT c_custkey,
        '<s><page_title> Customers </page_title> <section_title> ' || c_mktsegment
        || ' </section_title> <table> <row> <c> Name </c> <c> Account <row_header> Name '
        || '</row_header> </c> </row> <row> <c> ' || c_name || ' <col_header> Name </col_header> '
        || '</c> <c> ' || c_nationkey || ' <col_header> Account </col_header> <row_header> '
        || c_name || ' </row_header> </c> <highlighted_cell> ' || printf('%.2f', c_acctbal)
        || ' <col_header> Account </col_header> <row_header> ' || c_name
        || ' </row_header> </highlighted_cell> </row> </table>' || chr(10) || chr(10) AS linearized
    FROM customer""",
)
def linearize_spans(spark, sf_dir):
    grid = F.array(
        F.array(_cell(F.lit("Name"), header=True), _cell(F.lit("Account"), 2, True)),
        F.array(
            _cell(F.col("c_name"), header=True),
            _cell(F.col("c_nationkey").cast("string")),
            _cell(X.fixed_text(2)(F.col("c_acctbal"))),
        ),
    )
    # rows of a grid may differ in length; the array of rows needs one element type
    columns = ("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    return text_rows(spark, sf_dir, "customer", *columns).select(
        "c_custkey",
        G.linearize(
            grid, F.array(F.array(F.lit(1), F.lit(2))), F.lit("Customers"), F.col("c_mktsegment")
        ).alias("linearized"),
    )
