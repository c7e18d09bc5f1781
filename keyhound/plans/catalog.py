"""The library's queries over the tables at hand, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyhound.functions import expr
from keyhound.functions import text as T
from keyhound.operators import compose, decode, report, scan, validate
from keyhound.plans import configs, rules, services
from keyhound.plans.lineage import materialised, shared_folder
from keyhound.sources import exports, files

QUERIES: dict = {}
SQL: dict[str, str] = {}

TOKEN = r'token\s*=\s*"([0-9a-f]{40})"'
EMAIL = r"[a-z0-9._]+@[a-z0-9.]+\.[a-z]{2,}"
CARD = r"\b([0-9]{16})\b"
_TOKENS = f"(SELECT doc_id, source, text, unnest(regexp_extract_all(text, '{TOKEN}', 0)) AS match FROM documents)"
_SECRETS = f"(SELECT *, regexp_extract(match, '{TOKEN}', 1) AS secret FROM {_TOKENS})"
#: All matches with the text before each.
_PLACES = f"""(SELECT doc_id, text, match, substr(text, 1, CAST(c AS INTEGER)) AS pre FROM (
  SELECT doc_id, text, match, sum(length(b)) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(match)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, '{TOKEN}', 0)) AS match, unnest(regexp_split_to_array(text, '{TOKEN}')[1:len(regexp_extract_all(text, '{TOKEN}', 0))]) AS b, generate_subscripts(regexp_extract_all(text, '{TOKEN}', 0), 1) AS k FROM documents)))"""
_LINES = "(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _config(*parts: str) -> rules.Config:
    return rules.parse("\n".join(parts))


def _one(rule_id: str, regex: str, more: str = "") -> str:
    return f"[[rules]]\nid = '{rule_id}'\ndescription = '{rule_id}'\nregex = '''{regex}'''\n{more}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan.spread(scan.fragments(d, "text", "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))))


def found(spark: SparkSession, sf_dir: str, config: rules.Config) -> DataFrame:
    """Findings for joins with each other: the texts are scanned once."""
    return materialised(scan.findings(documents(spark, sf_dir), config))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.fragments(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", "page_id", F.col("url"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.findings(documents(spark, sf_dir), _config(_one("token", TOKEN, "keywords = ['token']")))


@query("SELECT source, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents WHERE text <> '' GROUP BY source")
def scan_fragments(spark, sf_dir):
    f = scan.prefiltered(documents(spark, sf_dir), rules.Config())
    source = F.substring_index(F.element_at("attributes", "path"), "/", 1)
    return f.where(F.col("raw") != "").groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).cast("bigint").alias("n_bytes"))


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '(?:\\.example\\.net/)|(?:#top$)')")
def prefilter_paths(spark, sf_dir):
    config = _config("prefilter = '''matchesAny(get(attributes, \"path\", \"\"), [`\\.example\\.net/`, `#top$`])'''")
    return scan.prefiltered(pages(spark, sf_dir), config).select(F.col("fragment_id").alias("page_id"))


@query("""
SELECT doc_id, rule_id FROM documents JOIN (VALUES ('hex-token', 'token'), ('generic-assignment', '='), ('email-address', '@'),
  ('license-line', 'license'), ('token-with-address', 'token')) v(rule_id, keyword) ON contains(lower(text), keyword)
UNION ALL SELECT doc_id, rule_id FROM documents CROSS JOIN (VALUES ('card-number'), ('ipv4-address')) v(rule_id)
""")
def keyword_candidates(spark, sf_dir):
    candidates = scan.keyword_candidates(documents(spark, sf_dir), rules.default_config())
    return candidates.withColumnRenamed("fragment_id", "doc_id")


@query(f"SELECT doc_id, match, secret FROM {_SECRETS}")
def match_token_rule(spark, sf_dir):
    return tokens(spark, sf_dir).select(F.col("fragment_id").alias("doc_id"), "match", "secret")


@query(f"SELECT doc_id, match, CAST(strlen(pre) AS INTEGER) AS byte_start FROM {_PLACES}")
def match_offsets(spark, sf_dir):
    """Every occurrence, repeats too."""
    m = scan.raw_matches(documents(spark, sf_dir), list(_config(_one("token", TOKEN)).rules.values()))
    return m.select(F.col("fragment_id").alias("doc_id"), "match", F.col("bstart").alias("byte_start"))


@query(f"""
WITH p AS (SELECT doc_id, match, pre FROM {_PLACES}),
q AS (SELECT *, CASE WHEN contains(pre, chr(10)) THEN strlen(regexp_extract(pre, '(?s)^.*\n')) - 1 ELSE 0 END AS nl FROM p)
SELECT doc_id, match, CAST(1 + length(pre) - length(replace(pre, chr(10), '')) AS INTEGER) AS start_line,
       CAST(strlen(pre) - nl + 1 AS INTEGER) AS start_column, CAST(strlen(pre) + strlen(match) - nl AS INTEGER) AS end_column FROM q
""")
def match_location(spark, sf_dir):
    return tokens(spark, sf_dir).select(F.col("fragment_id").alias("doc_id"), "match", "start_line", "start_column", "end_column")


@query(f"""
WITH p AS (SELECT doc_id, match, text, pre FROM {_PLACES}),
q AS (SELECT *, 1 + length(pre) - length(replace(pre, chr(10), '')) AS n FROM p)
SELECT doc_id, match, array_to_string(list_slice(string_split(text, chr(10)), greatest(n - 1, 1), n + 1), chr(10)) AS match_context FROM q
""")
def match_context_box(spark, sf_dir):
    t = scan.findings(documents(spark, sf_dir), _config(_one("token", TOKEN)), context="2L")
    return t.select(F.col("fragment_id").alias("doc_id"), "match", "match_context")


@query(f"SELECT doc_id, match, match AS match_context FROM {_TOKENS}")
def match_context_cols(spark, sf_dir):
    t = scan.findings(documents(spark, sf_dir), _config(_one("token", TOKEN)), context="0C")
    return t.select(F.col("fragment_id").alias("doc_id"), "match", "match_context")


@query(r"SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages")
def capture_map(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    f = scan.findings(scan.fragments(p, "url", "page_id"), _config(_one("url", r"^(?P<scheme>https?)://(?P<host>[^/?#]+)")))
    return f.select(F.col("fragment_id").alias("page_id"), F.element_at("capture_groups", "scheme").alias("scheme"), F.element_at("capture_groups", "host").alias("host"))


_ENTROPY = f"""
SELECT doc_id, secret, round(-sum(n / 40.0 * log2(n / 40.0)), 6) AS entropy FROM (
  SELECT doc_id, secret, c, count(*) AS n FROM (SELECT DISTINCT doc_id, secret FROM {_SECRETS}), unnest(string_split(secret, '')) u(c)
  GROUP BY ALL) GROUP BY ALL"""


@query(_ENTROPY)
def entropy_score(spark, sf_dir):
    return tokens(spark, sf_dir).select(F.col("fragment_id").alias("doc_id"), "secret").distinct().withColumn("entropy", F.round(T.byte_entropy(F.col("secret")), 6))


@query(f"SELECT DISTINCT doc_id, secret FROM ({_ENTROPY}) WHERE entropy > 3.7")
def entropy_filter(spark, sf_dir):
    f = scan.findings(documents(spark, sf_dir), _config(_one("token", TOKEN, "entropy = 3.7")))
    return f.select(F.col("fragment_id").alias("doc_id"), "secret").distinct()


def _keeps(spark, sf_dir, source: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return d.where(~expr.skips(source, {"finding": {"secret": F.col("text")}})).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT (contains(lower(text), 'license') OR contains(lower(text), '@mail'))")
def contains_any_filter(spark, sf_dir):
    return _keeps(spark, sf_dir, 'containsAny(finding["secret"], ["license", "@mail"])')


@query(r"SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?:[0-9]{16})|(?:\bToken\b)')")
def matches_any_filter(spark, sf_dir):
    return _keeps(spark, sf_dir, 'filter.matchesAny(finding["secret"], [`[0-9]{16}`, `\\bToken\\b`])')


@query(f"SELECT doc_id, regexp_extract(text, '{EMAIL}') AS found FROM documents")
def find_match(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", expr.compile_expr(f"findMatch(text, `{EMAIL}`)", {"text": F.col("text")}).alias("found"))


@query(f"SELECT doc_id, secret FROM {_SECRETS} WHERE doc_id % 2 = 1")
def allow_comment(spark, sf_dir):
    d = documents(spark, sf_dir)
    marked = F.when(F.col("fragment_id") % 2 == 0, F.replace("raw", F.lit("\n"), F.lit(" keyhound:allow\n"))).otherwise(F.col("raw"))
    d = d.withColumn("raw", F.when(F.col("fragment_id") % 2 == 0, F.concat(marked, F.lit(" keyhound:allow"))).otherwise(marked))
    return scan.findings(d, _config(_one("token", TOKEN))).select(F.col("fragment_id").alias("doc_id"), "secret")


@query(r"SELECT page_id, 'file detected: ' || url AS match FROM pages WHERE regexp_matches(url, '\.html$')")
def path_only_rule(spark, sf_dir):
    config = _config("[[rules]]\nid = 'page'\npath = '''\\.html$'''")
    return scan.findings(pages(spark, sf_dir), config).select(F.col("fragment_id").alias("page_id"), "match")


#: Texts of which an encoded form within other text is decoded: printable, and long enough as a run. What isn't stays out.
_PLAIN = r"regexp_full_match(text, '[\x09-\x7E]+')"
_B64 = "replace(base64(encode({0})), chr(10), '')"
_B1 = _B64.format("text")
_B2 = _B64.format(_B1)


def _run(b: str) -> str:
    """That a decoder takes a base64 text: sixteen characters without padding, and one that isn't a letter."""
    return f"length(rtrim({b}, '=')) >= 16 AND regexp_matches({b}, '[0-9+/]')"


def _decodes(condition: str) -> str:
    return f"SELECT doc_id, 'see ' || text || ' end' AS decoded FROM documents WHERE text <> '' AND {condition}"


def _encoded(spark, sf_dir, how) -> DataFrame:
    """Every text of documents, encoded within other text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text <> ''")
    return scan.spread(scan.fragments(d.withColumn("e", F.concat(F.lit("see "), how(F.col("text")), F.lit(" end"))), "e", "doc_id"))


def _decoded(f: DataFrame, depth: int) -> DataFrame:
    d = decode.decoded(f, depth)
    return d.where(F.col("pass") == depth).select(F.col("fragment_id").alias("doc_id"), F.col("raw").alias("decoded"))


def _base64(c):
    return F.regexp_replace(F.base64(c.cast("binary")), r"\s", "")


@query(_decodes(f"{_PLAIN} AND strlen(text) >= 16"))
def decode_hex(spark, sf_dir):
    return _decoded(_encoded(spark, sf_dir, lambda c: F.lower(F.hex(c.cast("binary")))), 1)


@query(_decodes(f"{_PLAIN} AND {_run(_B1)}"))
def decode_base64(spark, sf_dir):
    return _decoded(_encoded(spark, sf_dir, _base64), 1)


@query(_decodes(_PLAIN))
def decode_percent(spark, sf_dir):
    return _decoded(_encoded(spark, sf_dir, lambda c: F.regexp_replace(F.hex(c.cast("binary")), "(..)", "%$1")), 1)


@query(_decodes("true"))
def decode_unicode(spark, sf_dir):
    """Escapes of any character, printable or not, of the basic plane."""
    return _decoded(_encoded(spark, sf_dir, lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(....)", r"\\u$1")), 1)


@query(_decodes(f"{_PLAIN} AND {_run(_B1)} AND {_run(_B2)}"))
def decode_recursive(spark, sf_dir):
    return _decoded(_encoded(spark, sf_dir, lambda c: F.regexp_replace(F.hex(_base64(_base64(c)).cast("binary")), "(..)", "%$1")), 3)


def _near(within: int) -> rules.Config:
    more = f"[[rules.required]]\nid = 'email'\nwithinLines = {within}"
    return _config(_one("card", CARD, more), _one("email", EMAIL, "keywords = ['@']\nskipReport = true"))


def _each(name: str, pattern: str, group: int = 0) -> str:
    return f"{name} AS (SELECT doc_id, source, n, unnest(regexp_extract_all(line, '{pattern}', {group})) AS secret FROM {_LINES})"


_NEAR = f"WITH {_each('c', CARD, 1)}, {_each('e', EMAIL)} "


@query(_NEAR + "SELECT c.doc_id, CAST(c.n AS INTEGER) AS start_line, c.secret FROM c WHERE EXISTS (SELECT 1 FROM e WHERE c.doc_id = e.doc_id AND abs(c.n - e.n) <= 5)")
def composite_within_lines(spark, sf_dir):
    f = compose.composed(found(spark, sf_dir, _near(5)), _near(5))
    return f.select(F.col("fragment_id").alias("doc_id"), "start_line", "secret")


@query(_NEAR + "SELECT c.doc_id, CAST(c.n AS INTEGER) AS start_line, c.secret, CAST(least(100, count(DISTINCT (e.n, e.secret))) AS INTEGER) AS n_sets FROM c JOIN e ON c.doc_id = e.doc_id AND abs(c.n - e.n) <= 50 GROUP BY ALL")
def required_sets(spark, sf_dir):
    f = compose.composed(found(spark, sf_dir, _near(50)), _near(50))
    distinct = F.size(F.array_distinct(F.transform("required_sets", lambda s: F.struct(s["components"][0]["start_line"], s["components"][0]["secret"]))))
    return f.select(F.col("fragment_id").alias("doc_id"), "start_line", "secret", distinct.alias("n_sets")).distinct()


@query(f"""WITH {_each('t', TOKEN, 1)}, {_each('h', '[0-9a-f]{20,}')}
SELECT doc_id, 'token' AS rule_id, CAST(n AS INTEGER) AS start_line, secret FROM t
UNION ALL SELECT doc_id, 'hex', CAST(n AS INTEGER), secret FROM h WHERE NOT EXISTS
  (SELECT 1 FROM t WHERE t.doc_id = h.doc_id AND t.n = h.n AND contains(t.secret, h.secret))""")
def specificity_suppression(spark, sf_dir):
    config = _config(_one("token", TOKEN), _one("hex", "[0-9a-f]{20,}", "specificity = 0"))
    f = compose.suppressed(found(spark, sf_dir, config))
    return f.select(F.col("fragment_id").alias("doc_id"), "rule_id", "start_line", "secret")


_PRINTS = f"WITH {_each('t', TOKEN, 1)} SELECT doc_id, source || '/' || doc_id || '.txt:token:' || n AS fingerprint FROM t"


@query(f"SELECT * FROM ({_PRINTS}) WHERE doc_id % 2 = 1")
def fingerprint_ignore(spark, sf_dir):
    f = materialised(tokens(spark, sf_dir))
    listed = f.where(F.col("fragment_id") % 2 == 0).select(F.replace("fingerprint", F.lit("/"), F.lit("\\")).alias("value"))
    lines = listed.unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string"))
    return compose.without_ignored(f, compose.ignore_rows(lines)).select(F.col("fragment_id").alias("doc_id"), "fingerprint")


@query(f"SELECT * FROM ({_PRINTS}) WHERE doc_id % 3 <> 0")
def baseline_anti(spark, sf_dir):
    f = materialised(tokens(spark, sf_dir))
    return compose.without_baseline(f, f.where(F.col("fragment_id") % 3 == 0)).select(F.col("fragment_id").alias("doc_id"), "fingerprint")


@query(f"SELECT doc_id, secret[1:CAST(round_even(length(secret) * 0.7, 0) AS INTEGER)] || '...' AS secret, replace(match, secret, secret[1:CAST(round_even(length(secret) * 0.7, 0) AS INTEGER)] || '...') AS match FROM {_SECRETS}")
def redact_mask(spark, sf_dir):
    return compose.redacted(tokens(spark, sf_dir), 30).select(F.col("fragment_id").alias("doc_id"), "secret", "match")


@query(f"SELECT DISTINCT sha256('token' || chr(0) || secret) AS key FROM {_SECRETS}".replace("chr(0)", "decode('\\x00'::BLOB)"))
def validation_key(spark, sf_dir):
    return tokens(spark, sf_dir).select(validate.key(F.col("rule_id"), F.col("secret"), F.col("capture_groups")).alias("key")).distinct()


_STATUS = "CASE WHEN secret[1:1] < '4' THEN 'valid' WHEN secret[1:1] < '8' THEN 'invalid' WHEN secret[1:1] < 'b' THEN 'unknown' ELSE '' END"


def _validated(spark, sf_dir) -> DataFrame:
    def evaluate(keys):
        first = F.substring("secret", 1, 1)
        result = F.when(first < "4", F.lit("VALID")).when(first < "8", F.lit("invalid")).otherwise(F.lit("odd"))
        return keys.where(first < "b").select("key", result.alias("result"), F.lit("table").alias("reason"), F.create_map(F.lit("a"), F.lit("")).alias("metadata"))

    return validate.validated(tokens(spark, sf_dir), None, evaluate)


@query(f"SELECT coalesce(nullif({_STATUS}, ''), 'none') AS status, count(*) AS n FROM {_SECRETS} GROUP BY 1")
def status_counts(spark, sf_dir):
    return validate.status_counts(_validated(spark, sf_dir))


@query(f"SELECT doc_id, secret FROM {_SECRETS} WHERE {_STATUS} IN ('valid', '')")
def status_filter(spark, sf_dir):
    return validate.with_status(_validated(spark, sf_dir), ["valid", "none"]).select(F.col("fragment_id").alias("doc_id"), "secret")


_MAIL = "CASE WHEN e.secret < 'h' THEN 6 WHEN e.secret < 'p' THEN 2 ELSE 0 END"


@query(_NEAR + f"""SELECT doc_id, start_line, secret, CASE r WHEN 6 THEN 'valid' WHEN 2 THEN 'invalid' ELSE '' END AS validation_status, all_valid FROM (
  SELECT c.doc_id, CAST(c.n AS INTEGER) AS start_line, c.secret, max({_MAIL}) AS r, max({_MAIL}) = 6 AS all_valid FROM c JOIN e ON c.doc_id = e.doc_id AND abs(c.n - e.n) <= 50 GROUP BY ALL)""")
def validation_sets(spark, sf_dir):
    """Composites by the addresses near them: the best of a card's sets counts, and only valid sets stay if there are any."""

    def evaluate(keys):
        mail = F.element_at("captures", "email")
        return keys.where(mail < "p").select("key", F.when(mail < "h", F.lit("valid")).otherwise(F.lit("invalid")).alias("result"), mail.alias("reason"), F.create_map(F.lit("mail"), mail).alias("metadata"))

    cards = compose.composed(found(spark, sf_dir, _near(50)), _near(50))
    v = validate.validated_sets(cards, None, evaluate)
    all_valid = F.forall("required_sets", lambda s: s["validation_status"] == "valid")
    return v.select(F.col("fragment_id").alias("doc_id"), "start_line", "secret", "validation_status", all_valid.alias("all_valid")).distinct()


@query(f"SELECT source, max_by(s, CASE s WHEN 'valid' THEN 6 WHEN 'unknown' THEN 3 WHEN 'invalid' THEN 2 ELSE 0 END) AS validation_status FROM (SELECT source, {_STATUS} AS s FROM {_SECRETS}) GROUP BY source")
def validation_rollup(spark, sf_dir):
    v = _validated(spark, sf_dir).withColumn("source", F.substring_index(F.element_at("attributes", "path"), "/", 1))
    return validate.rollup(v, ["source"], "fragment_id").select("source", "validation_status")


@query(f"""WITH {_each('t', TOKEN, 1)}, {_each('e', EMAIL)}
SELECT rule_id, count(*) AS hits, count(DISTINCT secret) AS secrets FROM (SELECT 'token' AS rule_id, secret FROM t UNION ALL SELECT 'email', secret FROM e) GROUP BY 1""")
def rule_stats(spark, sf_dir):
    f = scan.findings(documents(spark, sf_dir), _config(_one("token", TOKEN), _one("email", EMAIL, "keywords = ['@']")))
    return compose.rule_stats(f).drop("avg_entropy")


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'https://github.com/a/b/blob/' || md5(CAST(o_orderkey AS VARCHAR)) || '/src/x%20y.txt#L' || (o_orderkey % 50) || '-L' || (o_orderkey % 50 + 2)
  WHEN 1 THEN 'https://gitlab.com/a/b/blob/' || md5(CAST(o_orderkey AS VARCHAR)) || '/src/x%20y.txt#L' || (o_orderkey % 50) || '-' || (o_orderkey % 50 + 2)
  ELSE 'https://bitbucket.org/a/b/src/' || md5(CAST(o_orderkey AS VARCHAR)) || '/src/x%20y.txt#lines-' || (o_orderkey % 50) || ':' || (o_orderkey % 50 + 2) END AS link FROM orders""")
def scm_links(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    third = F.col("o_orderkey") % 3
    remote = F.when(third == 0, F.lit("git@github.com:a/b.git")).when(third == 1, F.lit("https://user:pw@gitlab.com/a/b.git")).otherwise(F.lit("ssh://git@bitbucket.org/a/b.git"))
    web = files.web_remote(remote)
    start = F.col("o_orderkey") % 50
    link = T.scm_link(files.platform(web), web, F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit("src/x y.txt"), start, start + 2)
    return o.select("o_orderkey", link.alias("link"))


@query(f"""WITH {_each('t', TOKEN, 1)} SELECT 'token' AS "RuleID", source || '/' || doc_id || '.txt' AS "File", secret AS "Secret", CAST(n AS INTEGER) AS "StartLine", source || '/' || doc_id || '.txt:token:' || n AS "Fingerprint", '' AS "Tags" FROM t""")
def report_csv_rows(spark, sf_dir):
    return report.csv_rows(tokens(spark, sf_dir)).select("RuleID", "File", "Secret", "StartLine", "Fingerprint", "Tags")


@query(f"""WITH {_each('t', TOKEN, 1)} SELECT doc_id, secret, CAST(n AS INTEGER) AS line FROM t""")
def report_json_rows(spark, sf_dir):
    j = report.json_rows(tokens(spark, sf_dir))
    of = lambda k: F.get_json_object("json", f"$.{k}")
    return j.select(F.regexp_extract(of("File"), r"/(\d+)\.txt", 1).cast("bigint").alias("doc_id"), of("Secret").alias("secret"), of("StartLine").cast("int").alias("line"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE text <> ''")
def chunk_fragments(spark, sf_dir):
    c = files.chunked(documents(spark, sf_dir), 2000, 500)
    return c.groupBy(F.col("fragment_id").alias("doc_id")).agg(F.sum(F.octet_length("raw")).cast("bigint").alias("n_bytes"))


@query("SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS sha, source || '/' || doc_id || '.txt' AS path, CAST(7 AS INTEGER) AS start_line, text || chr(10) AS raw FROM documents")
def patch_hunks(spark, sf_dir):
    """Texts as added lines of a patch, read back with their commits' attributes."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    added = F.concat(F.lit("+"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    head = F.format_string("commit %s\nAuthor: A B <a@b.c>\nDate:   2024-01-01\n\n    said\n\ndiff --git a/%s b/%s\n--- a/%s\n+++ b/%s\n@@ -7,0 +7,%d @@\n", F.md5(F.col("doc_id").cast("string").cast("binary")), path, path, path, path, F.size(F.split("text", "\n", -1)))
    f = files.patch_fragments(d.select("doc_id", F.concat(head, added).alias("patch")), "patch", "doc_id")
    return f.select(F.substring_index("fragment_id", ":", 1).cast("bigint").alias("doc_id"), F.element_at("attributes", "git.sha").alias("sha"), F.element_at("attributes", "path").alias("path"), "start_line", "raw")


@query("SELECT doc_id || '.zip!in/' || doc_id || '.tar!' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE text <> ''")
def archive_members(spark, sf_dir):
    """Each text in a tar, compressed, in a zip; read back as files of archives."""
    f = files.file_fragments(files.archived(documents(spark, sf_dir)))
    return f.groupBy(F.element_at("attributes", "path").alias("path")).agg(F.sum(F.octet_length("raw")).cast("bigint").alias("n_bytes"))


@query("SELECT doc_id, CASE WHEN source = '' OR source IS NULL THEN 'unknown' ELSE source END AS source, 'documents' AS resource FROM documents")
def attribute_stamp(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("resource"), F.lit("file"))
    f = files.with_attributes(scan.fragments(d, "text", "doc_id", attributes=own), {"source": "unknown", "resource": "documents"})
    return f.select(F.col("fragment_id").alias("doc_id"), F.element_at("attributes", "source").alias("source"), F.element_at("attributes", "resource").alias("resource"))


@query("""SELECT doc_id, CASE WHEN lang = 'fr' THEN 'storage_class:GLACIER' WHEN strlen(text) > 5000 THEN 'size_limit' WHEN strlen(text) = 0 THEN 'empty'
  WHEN doc_id % 10 = 0 THEN 'directory' ELSE '' END AS reason FROM documents""")
def object_skips(spark, sf_dir):
    """Texts as the objects of a store: which wouldn't be read, and why."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat("source", F.when(F.col("doc_id") % 10 == 0, F.lit("/")).otherwise(F.lit("/x")))
    reason = files.skip_reason(path, F.octet_length("text"), F.when(F.col("lang") == "fr", F.lit("GLACIER")).otherwise(F.lit("STANDARD")), 5000)
    return d.select("doc_id", reason.alias("reason"))


@query("SELECT rule_id, has_filter, n_keywords FROM (VALUES ('hex-token', true, 1), ('generic-assignment', false, 1), ('email-address', false, 1), ('license-line', false, 1), ('card-number', false, 0), ('ipv4-address', false, 0), ('token-with-address', false, 1)) v(rule_id, has_filter, n_keywords)")
def config_rules(spark, sf_dir):
    """The default rules as they are after loading, rendering and loading again."""
    config = rules.parse(configs.rendered(rules.default_config()))
    configs.checked(config)
    return spark.createDataFrame([(r.id, bool(r.filter), len(r.keywords)) for r in config.rules.values()], "rule_id string, has_filter boolean, n_keywords int")


@query(f"""SELECT doc_id, secret FROM {_SECRETS} WHERE NOT (contains(secret, 'abc') OR regexp_matches(secret, '^0'))
  AND NOT (regexp_matches(source || '/' || doc_id || '.txt', '^src1') AND contains(secret, '7'))""")
def allowlist_and_or(spark, sf_dir):
    lists = "[[rules.allowlists]]\nregexes = ['^0']\nstopwords = ['ABC']\n[[rules.allowlists]]\ncondition = 'AND'\npaths = ['^src1']\nstopwords = ['7']\n"
    f = scan.findings(documents(spark, sf_dir), _config(_one("token", TOKEN, lists)))
    return f.select(F.col("fragment_id").alias("doc_id"), "secret")


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND ts < (SELECT min(ts) + INTERVAL 3 DAY FROM events)")
def date_range(spark, sf_dir):
    from datetime import timedelta

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    first = e.agg(F.min("ts")).first()[0]
    return e.where(files.in_range(F.col("ts"), first + timedelta(days=1), first + timedelta(days=3))).select("event_id")


@query("SELECT page_id FROM pages WHERE NOT (regexp_full_match(url, 'https://[^/]*/en/[^/]*') OR regexp_full_match(url, 'http://m\\.[^/]*/[^/][^/]/[^/]*'))")
def exclude_globs(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.where(~files.excluded(F.col("url"), ["https://*/en/*", "http://m.*/??/*"])).select("page_id")


@query("""SELECT doc_id, CAST(strlen(text) AS INTEGER) AS size, md5(text) AS md5, lower(hex(encode(substr(source, 2)))) AS hex, base64(encode(source)) AS b64,
  CASE WHEN contains(text, 'the') THEN 'x' ELSE 'y' END AS pick, lang IN ('en', 'fr') AS listed FROM documents""")
def expression_functions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scope = {c: F.col(c) for c in ("text", "source", "lang")}
    said = {
        "size": "size(text)", "md5": "hex.encode(crypto.md5(text))", "hex": "hex.encode(bytes(substring(source, 1)))", "b64": "base64.encode(bytes(source))",
        "pick": 'let t = text; t contains "the" ? "x" : "y"', "listed": 'lang in ["en", "fr"]',
    }
    return d.select("doc_id", *[expr.compile_expr(s, scope).alias(k) for k, s in said.items()])


@query()
def token_efficiency(spark, sf_dir):
    from keyhound.functions.efficiency import column

    import public_tokenizers

    fails = column(public_tokenizers.path("byte_bpe_50k.json"), frozenset({"token", "secret", "password"}))
    config = _config(_one("generic", r'(\w+)\s*=\s*"([0-9a-zA-Z+/_-]{16,})"', "secretGroup = 2\ntokenEfficiency = true"))
    return scan.findings(documents(spark, sf_dir), config, {"filter.failsTokenEfficiency": fails}).select("fragment_id", "secret")


@query(f"SELECT doc_id, secret FROM {_SECRETS}")
def stream_scan(spark, sf_dir):
    from keyhound.streaming.scan import stream_findings, write_findings

    out, path = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}", f"{sf_dir}/documents.parquet"
    found = stream_findings(spark, path, spark.read.parquet(path).schema, _config(_one("token", TOKEN, "keywords = ['token']")))
    write_findings(found.select("fragment_id", "secret"), f"{out}/rows", f"{out}/state").awaitTermination()
    return spark.read.schema("fragment_id bigint, secret string").parquet(f"{out}/rows").select(F.col("fragment_id").alias("doc_id"), "secret")


@query()
def full_scan(spark, sf_dir):
    """All default rules, one pass of decoding, composition and suppression."""
    f = compose.scan(documents(spark, sf_dir), rules.default_config(), depth=1)
    return f.select("fragment_id", "rule_id", "start_line", "start_column", "end_column", "secret", "tags", "fingerprint")


_SERVICES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(services.SERVICES))


@query(f"""SELECT doc_id, name || '-' || kind AS rule_id, md5(CAST(doc_id AS VARCHAR)) AS secret, 1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS start_line
FROM documents JOIN (VALUES {_SERVICES}) v(i, name) ON doc_id % {len(services.SERVICES)} = i, (VALUES ('key'), ('secret')) k(kind)""")
def many_rules(spark, sf_dir):
    """Over four hundred rules at once: each text gets lines with a key and a secret of some service, each found by its rule."""
    name = F.element_at(F.array(*map(F.lit, services.SERVICES)), (F.col("doc_id") % len(services.SERVICES) + 1).cast("int"))
    secret = F.md5(F.col("doc_id").cast("string").cast("binary"))
    planted = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), name, F.lit('_api_key = "'), secret, F.lit('", '), F.upper(name), F.lit("_CLIENT_SECRET: '"), secret, F.lit("'"))
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted.alias("text"))
    f = scan.findings(scan.spread(scan.fragments(d, "text", "doc_id")), services.all_rules())
    of_services = f.where(F.array_contains("tags", "key") | F.array_contains("tags", "secret"))
    # Rules of the sample that tag their findings alike are left out.
    mine = of_services.where(F.size("tags") == 2).where(~F.col("rule_id").isin("hex-token"))
    return mine.select(F.col("fragment_id").alias("doc_id"), "rule_id", "secret", F.col("start_line").cast("bigint").alias("start_line"))


@query(f"""WITH {_each('t', TOKEN, 1)}, {_each('k', 'token')}
SELECT t.doc_id, 'composite' AS rule_id, CAST(t.n AS INTEGER) AS start_line, t.secret FROM t WHERE EXISTS (SELECT 1 FROM k WHERE k.doc_id = t.doc_id AND k.n = t.n)
UNION ALL SELECT k.doc_id, 'word', CAST(k.n AS INTEGER), k.secret FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = k.doc_id AND t.n = k.n)""")
def component_suppression(spark, sf_dir):
    """A word that a composite on its line has for a component isn't a finding of its own."""
    config = _config(_one("composite", TOKEN, "[[rules.required]]\nid = 'word'\nwithinLines = 0"), _one("word", "token"))
    f = compose.suppressed(compose.composed(found(spark, sf_dir, config), config))
    return f.select(F.col("fragment_id").alias("doc_id"), "rule_id", "start_line", "secret")


@query("SELECT '0' AS source, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents UNION ALL SELECT '1', count(*), CAST(sum(strlen(coalesce(html, ''))) AS BIGINT) FROM pages")
def union_sources(spark, sf_dir):
    f = files.union(documents(spark, sf_dir), pages(spark, sf_dir))
    return f.groupBy(F.substring_index("fragment_id", ":", 1).alias("source")).agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).cast("bigint").alias("n_bytes"))


@query(f"SELECT doc_id, match FROM {_PLACES} WHERE strlen(pre) >= 500 AND NOT contains(regexp_extract(pre, '[^\\n]*\\z'), 'a')")
def filter_context(spark, sf_dir):
    """A filter that reads where a match is, the text before it on its line, and the context around it."""
    source = 'let before = finding["fragment_raw"][finding["match_line_start_idx"]:finding["match_start_idx"]]; before contains "a" || finding["match_start_idx"] < 500 || !(finding["context"] contains finding["match"])'
    f = scan.findings(documents(spark, sf_dir), _config(_one("token", TOKEN, f"filter = '''{source}'''")))
    return f.select(F.col("fragment_id").alias("doc_id"), "match")


@query("""WITH f AS (SELECT conv_id, max_by(text, turn) FILTER (turn = 0) AS title FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, turn, coalesce(text, '') AS text, role FROM conversations)
SELECT 'chats/issues/' || conv_id AS path, 'issue' AS resource, CAST(strlen(trim(coalesce(title, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS BIGINT) AS n_bytes FROM f
  WHERE trim(coalesce(title, ''), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''
UNION ALL SELECT 'chats/issues/' || conv_id, 'comment', CAST(strlen(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))) AS BIGINT) FROM t
  WHERE turn > 0 AND role <> 'system' AND trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''""")
def thread_fragments(spark, sf_dir):
    """Conversations as an export of issues: the first turn is the title, the others are comments."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    note = F.struct(F.col("turn").alias("id"), F.col("text"), F.lit(None).cast("timestamp").alias("created"), (F.col("role") == "system").alias("system"))
    t = c.groupBy(F.col("conv_id").alias("number")).agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("title"), F.collect_list(F.when(F.col("turn") > 0, note)).alias("comments"))
    t = t.select(F.lit("chats").alias("repo"), "number", "title", F.lit("").alias("body"), F.lit("").alias("url"), F.lit(None).cast("timestamp").alias("created"), "comments")
    of = lambda a: F.element_at("attributes", a).alias(a)
    return exports.threads(t).select(of("path"), of("resource"), F.octet_length("raw").cast("bigint").alias("n_bytes"))
