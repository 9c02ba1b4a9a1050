"""Text and document queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import constraints as C
from strandline.functions import text as X
from strandline.operators.graph import settle
from strandline.plans.registry import query
from strandline.session import table

def _condition():
    return F.concat(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")), F.lit(" >= "), F.col("p_size").cast("string"), F.lit(", limit < "), F.col("p_partkey").cast("string"))


@query(
    "condition_tokens",
    r"""WITH c AS (SELECT p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) || ' >= ' || p_size || ', limit < ' || p_partkey AS t FROM part)
    SELECT p_partkey, regexp_extract_all(t, '[a-z_][a-z0-9_]*') AS variables, regexp_extract(t, '^([a-z0-9_]+) (>=|<)', 2) AS operator, regexp_extract(t, '(>=|<) ([0-9]+)', 2) AS value FROM c""",
)
def condition_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = C.parse_constraint(_condition())
    return table(spark, sf_dir, "part").select("p_partkey", X.identifiers(_condition()).alias("variables"), first["operator"].alias("operator"), first["value"].alias("value"))


@query(
    "fourcc_fold",
    """SELECT p_partkey, (ascii(p_name[1]) + (ascii(p_name[2]) << 8) + (ascii(p_name[3]) << 16) + (ascii(p_name[4])::BIGINT << 24))::BIGINT AS code FROM part""",
)
def fourcc_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.fold_four(F.col("p_name")).alias("code"))


@query(
    "constraint_clashes",
    """WITH v AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN '<' WHEN 'O' THEN '>=' ELSE '==' END AS op, round(o_totalprice) AS v, lag(CASE o_orderstatus WHEN 'F' THEN '<' WHEN 'O' THEN '>=' ELSE '==' END) OVER w AS pop, lag(round(o_totalprice)) OVER w AS pv FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    b AS (SELECT *, CASE WHEN op IN ('==', '>=') THEN v ELSE '-inf'::DOUBLE END AS l1, CASE op WHEN '==' THEN v WHEN '<' THEN v - abs(v) * 1e-9 ELSE 'inf'::DOUBLE END AS h1, CASE WHEN pop IN ('==', '>=') THEN pv ELSE '-inf'::DOUBLE END AS l2, CASE pop WHEN '==' THEN pv WHEN '<' THEN pv - abs(pv) * 1e-9 ELSE 'inf'::DOUBLE END AS h2 FROM v WHERE pop IS NOT NULL)
    SELECT o_orderkey, greatest(l1, l2) > least(h1, h2) AS clash FROM b""",
)
def constraint_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each order's price constraint excludes the one of the customer's order before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    op = F.when(F.col("o_orderstatus") == "F", "<").when(F.col("o_orderstatus") == "O", ">=").otherwise("==")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", op.alias("op"), F.round("o_totalprice").alias("v"))
    rows = rows.withColumns({"pop": F.lag("op").over(w), "pv": F.lag("v").over(w)}).where("pop IS NOT NULL")
    return rows.select("o_orderkey", C.intervals_clash(F.col("op"), F.col("v"), F.col("pop"), F.col("pv")).alias("clash"))


@query("json_scan", """SELECT event_type, (props->>'k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY ALL""")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query(
    "html_metadata",
    r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, trim(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '\s+', ' ', 'g'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&')) AS title FROM pages""",
)
def html_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), X.strip_tags(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("title"))


@query("line_explode", """SELECT doc_id, (generate_subscripts(l, 1))::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


@query(
    "line_drift",
    """WITH l AS (SELECT doc_id, (generate_subscripts(l, 1))::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    h AS (SELECT doc_id, line AS head FROM l WHERE line_no = 1 AND trim(line) <> ''), g AS (SELECT head, min(doc_id) AS first_doc FROM h GROUP BY head HAVING count(*) > 1),
    p AS (SELECT h.doc_id, first_doc FROM h JOIN g USING (head) WHERE h.doc_id <> first_doc)
    SELECT p.doc_id, first_doc, least(count(*), 200)::BIGINT AS n_drift, greatest(count(*) - 200, 0)::BIGINT AS n_overflow, min(a.line_no) AS first_line
    FROM p JOIN l a ON a.doc_id = p.doc_id JOIN l b ON b.doc_id = p.first_doc AND a.line_no = b.line_no WHERE trim(a.line, ' ') <> trim(b.line, ' ') GROUP BY ALL""",
)
def line_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that begin like an earlier one: how many of their lines differ from it, told up to 200 with the rest counted."""
    lines = line_explode(spark, sf_dir)
    heads = lines.where("line_no = 1 AND trim(line) <> ''").select("doc_id", F.col("line").alias("head"))
    groups = heads.groupBy("head").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).where("n > 1").select("head", "first_doc")
    pairs = heads.join(groups, "head").where("doc_id <> first_doc").select("doc_id", "first_doc")
    other = lines.select(F.col("doc_id").alias("first_doc"), "line_no", F.col("line").alias("other"))
    differ = lines.join(pairs, "doc_id").join(other, ["first_doc", "line_no"]).where(F.trim("line") != F.trim("other"))
    per = differ.groupBy("doc_id", "first_doc").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))
    return per.select("doc_id", "first_doc", F.least("n", F.lit(200)).cast("long").alias("n_drift"), F.greatest(F.col("n") - 200, F.lit(0)).cast("long").alias("n_overflow"), "first_line")


@query(
    "normalized_identity",
    r"""WITH n AS (SELECT doc_id, md5(regexp_replace(text, '\s+', '', 'g')) AS k FROM documents) SELECT k AS identity, min(doc_id) AS first_doc, count(*)::BIGINT AS n_docs FROM n GROUP BY k HAVING count(*) > 1""",
)
def normalized_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.regexp_replace("text", r"\s+", "").cast("binary"))
    return table(spark, sf_dir, "documents").groupBy(key.alias("identity")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs")).where("n_docs > 1")


@query(
    "callsite_count",
    r"""WITH b AS (SELECT item_id, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS p FROM benchmark), k AS (SELECT item_id, p, len(p) AS n, array_to_string(p[1:5], ' ') AS key FROM b WHERE p <> ['']),
    d AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS w FROM documents),
    s AS (SELECT doc_id, i, array_to_string(w[i:i + z - 1], ' ') AS key FROM d, unnest(range(1, len(w) + 1)) AS t(i), (SELECT DISTINCT least(n, 5) AS z FROM k) WHERE i + z - 1 <= len(w)),
    h AS (SELECT item_id, doc_id, i, p, n FROM k JOIN s USING (key)),
    c AS (SELECT item_id, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM h JOIN d USING (doc_id) WHERE w[i:i + h.n - 1] = p GROUP BY item_id)
    SELECT item_id, CASE WHEN coalesce(c.n, 0) <= 20 THEN coalesce(c.n, 0) END AS n_sites, coalesce(n_docs, 0) AS n_docs FROM k LEFT JOIN c USING (item_id)""",
)
def callsite_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each benchmark passage occurs in the documents, word for word; more than 20 sites count as unknown (null).

    A passage's first words, five at most, are its key: windows of as many words meet it by equality, and the passage is
    then compared whole at that place. Passages without words are left out."""
    words = F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")
    keys = table(spark, sf_dir, "benchmark").select("item_id", words.alias("p")).where("p <> array('')").withColumns({"n": F.size("p"), "key": F.xxhash64(F.slice("p", 1, 5))})
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    sizes = sorted(r[0] for r in keys.select(F.least("n", F.lit(5))).distinct().collect())  # five values at most
    window = lambda z: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - z + 1, F.lit(1))), lambda i: F.struct(i.alias("i"), F.xxhash64(F.slice("w", i, z)).alias("key")))
    windows = docs.select("doc_id", F.explode(F.concat(*map(window, sizes))).alias("s")).select("doc_id", "s.*") if sizes else docs.selectExpr("doc_id", "1 AS i", "0L AS key").limit(0)
    # few places hold a key: once written, these decide which documents are read again, instead of shuffling all words
    hits = settle(windows.join(keys, "key").select("item_id", "doc_id", "i", "p", "n"))
    found = hits.join(docs, "doc_id").where(F.slice("w", F.col("i"), F.col("n")) == F.col("p"))
    counts = found.groupBy("item_id").agg(F.count("*").alias("k"), F.count_distinct("doc_id").alias("n_docs"))
    k = F.coalesce("k", F.lit(0))
    return keys.select("item_id").join(counts, "item_id", "left").select("item_id", F.when(k <= 20, k).alias("n_sites"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("artifact_keys", r"""SELECT page_id, substr(regexp_replace(url, '[^\w.-]', '_', 'g'), 1, 80) AS key FROM pages""")
def artifact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.artifact_key(F.col("url")).alias("key"))
