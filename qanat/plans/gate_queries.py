"""Queries of the content gate, the held-out joins and the scanners."""

from __future__ import annotations

from pyspark.sql import functions as F

from qanat.functions import patterns
from qanat.functions.text import excerpt, sentences, space_words, stripped_lines, tokens
from qanat.operators import gate
from qanat.plans.registry import Tables, query, words_sql
from qanat.sources import sinks


def documents(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def edited(t: Tables):
    """Documents, and copies of some of them under the negative id, a sentence longer."""
    own = documents(t)
    copies = own.where("id % 50 = 7").select((-F.col("id")).alias("id"), F.concat(F.lit("Read this again. "), "text").alias("text"))
    return own.union(copies)


def quoting(t: Tables):
    """Documents by their ids as text, and one for every held-out text that quotes most of it."""
    own = documents(t).select(F.col("id").cast("string").alias("id"), "text")
    return own.union(references(t).select("ref", F.concat(F.lit("It was said: "), F.expr("substring(text, 1, 9 * length(text) div 10)"), F.lit(" or so."))))


def references(t: Tables):
    """(ref, text) of the held-out suite: user and expected texts of every turn."""
    turns = t.scenarios.select("id", F.posexplode("turns").alias("p", "x"))
    each = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"x.{f}").alias("text")) for f in ("expected", "user")])
    return turns.select("id", "p", F.explode(each).alias("e")).select(F.concat_ws("/", "id", F.lpad(F.col("p").cast("string"), 2, "0"), "e.f").alias("ref"), "e.text").where("text IS NOT NULL")


W = words_sql("text", form=True)
DOCS = f"docs AS (SELECT doc_id AS id, text, coalesce({W}, []) AS w FROM documents)"
EDITED = DOCS.replace("FROM documents)", "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, 'Read this again. ' || text FROM documents WHERE doc_id % 50 = 7))")
HELD = """SELECT ref, text FROM (
  SELECT id || '/' || lpad(CAST(i - 1 AS VARCHAR), 2, '0') || '/' || f AS ref, CASE WHEN f = 'user' THEN turns[i].user ELSE turns[i].expected END AS text
  FROM (SELECT id, turns, unnest(range(1, len(turns) + 1)) AS i FROM scenarios) s, (VALUES ('expected'), ('user')) v(f)) WHERE text IS NOT NULL"""
REFS = f"refs AS (SELECT ref, coalesce({W}, []) AS w FROM ({HELD}))"


def grams(source: str, n: int, key: str = "id", distinct: bool = False) -> str:
    return f"(SELECT {'DISTINCT ' * distinct}{key}, i - 1 AS p, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM {source}))"


NEAR = f"""posts AS (SELECT DISTINCT id, g FROM {grams('(SELECT * FROM docs WHERE len(w) >= 10)', 5)}),
  sizes AS (SELECT id, count(*) AS n FROM posts GROUP BY id),
  useful AS (SELECT g FROM posts GROUP BY g HAVING count(*) BETWEEN 2 AND 100),
  inter AS (SELECT a.id AS l, b.id AS r, count(*) AS s FROM posts a JOIN useful USING (g) JOIN posts b USING (g) WHERE a.id < b.id GROUP BY 1, 2),
  near AS (SELECT l AS left_id, r AS right_id, s / (x.n + y.n - s) AS similarity FROM inter JOIN sizes x ON x.id = l JOIN sizes y ON y.id = r
    JOIN docs dl ON dl.id = l JOIN docs dr ON dr.id = r WHERE dl.w <> dr.w AND s / (x.n + y.n - s) >= 0.82)"""
FLAGS = f"""{DOCS}, {REFS}, {NEAR},
  flagged AS (
    SELECT id, 'exact_corpus_duplicate' AS code, 'block' AS severity FROM docs WHERE len(w) > 0 AND w IN (SELECT w FROM docs GROUP BY w HAVING count(*) > 1)
    UNION SELECT left_id, 'near_corpus_duplicate', 'block' FROM near UNION SELECT right_id, 'near_corpus_duplicate', 'block' FROM near
    UNION SELECT id, 'repeated_templated_opening', 'review' FROM docs WHERE len(w) >= 8 AND w[1:8] IN (SELECT w[1:8] FROM docs WHERE len(w) >= 8 GROUP BY 1 HAVING count(DISTINCT id) >= 3)
    UNION SELECT id, 'suspicious_shared_verbatim_span', 'review' FROM {grams('docs', 16)} WHERE g IN (SELECT g FROM {grams('docs', 16)} GROUP BY g HAVING count(DISTINCT id) > 1)
    UNION SELECT id, 'heldout_eval_phrase_overlap', 'block' FROM {grams('docs', 8)} WHERE g IN (SELECT g FROM {grams('refs', 8, 'ref')}))"""


@query(f"WITH {DOCS} SELECT sha256(array_to_string(w, ' ')) AS text_sha256, count(*) AS copies, min(id) AS first_id, max(id) AS last_id FROM docs WHERE len(w) > 0 GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t):
    return gate.exact_duplicates(documents(t))


@query(f"WITH {EDITED}, {NEAR} SELECT * FROM near")
def near_duplicates(t):
    return gate.near_duplicates(edited(t))


@query(f"WITH {EDITED}, {NEAR.replace('BETWEEN 2 AND 100', '>= 2')} SELECT * FROM near")
def near_duplicates_uncapped(t):
    return gate.near_duplicates(edited(t), cap=None)


@query(f"WITH {DOCS} SELECT array_to_string(w[1:8], ' ') AS opening, count(*) AS occurrences, count(DISTINCT id) AS records FROM docs WHERE len(w) >= 8 GROUP BY 1 HAVING count(DISTINCT id) >= 3")
def repeated_openings(t):
    return gate.openings(documents(t))


@query(f"""WITH {DOCS}, sets AS (SELECT g, list_sort(list(DISTINCT id)) AS ids FROM {grams('docs', 16)} GROUP BY g)
  SELECT min(g) AS span, len(ids) AS records, ids[1] AS first_id, ids[-1] AS last_id FROM sets WHERE len(ids) > 1 GROUP BY ids""")
def shared_spans(t):
    return gate.shared_spans(documents(t))


OVERLAP = f"""hits AS (SELECT id, ref, a.p, b.p AS q, a.p - b.p AS d FROM {grams('texts', 8)} a JOIN {grams('refs', 8, 'ref')} b USING (g)),
  isles AS (SELECT *, p - row_number() OVER (PARTITION BY id, ref, d ORDER BY p) AS i FROM hits),
  runs AS (SELECT id, ref, count(*) + 7 AS overlap_words, min(p) AS start, min(q) AS q FROM isles GROUP BY id, ref, d, i)
  SELECT id, ref, overlap_words, start FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap_words DESC, start, ref, q) AS k FROM runs) WHERE k = 1"""


@query(f"WITH {DOCS}, {REFS}, texts AS (SELECT * FROM docs), {OVERLAP}")
def eval_overlap_longest(t):
    return gate.longest_overlaps(documents(t), references(t))


@query(f"""WITH {REFS}, told AS (SELECT ref, 'It was said: ' || substr(text, 1, CAST(9 * length(text) // 10 AS INTEGER)) || ' or so.' AS text FROM ({HELD})),
  docs AS (SELECT id, coalesce({W}, []) AS w FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT ref, text FROM told))
  SELECT DISTINCT id FROM {grams('docs', 12)} WHERE g IN (SELECT g FROM {grams('refs', 12, 'ref')})""")
def ngram_contamination_12(t):
    return gate.contaminated(quoting(t), references(t), 12)


@query(f"WITH {DOCS}, {REFS} SELECT id FROM docs WHERE id NOT IN (SELECT id FROM {grams('docs', 8)} WHERE g IN (SELECT g FROM {grams('refs', 8, 'ref')}))")
def decontaminated_documents(t):
    own = documents(t)
    return own.select("id").join(gate.contaminated(own, references(t), 8), "id", "left_anti")


STRIP = r"regexp_replace(regexp_replace(regexp_replace(nfc_normalize({0}), '\r\n?', chr(10), 'g'), '(?m)[\s\p{{Z}}\x{{85}}]+$', '', 'g'), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"


@query(f"""WITH texts AS (SELECT i, id, t, f, CASE WHEN f = 'user' THEN turns[t].user ELSE turns[t].expected END AS x FROM (
    SELECT row_number() OVER (ORDER BY id) AS i, id, turns, unnest(range(1, len(turns) + 1)) AS t FROM scenarios), (VALUES ('user'), ('expected')) v(f)),
  held AS (SELECT DISTINCT sha256({STRIP.format("x")}) AS h FROM texts WHERE x IS NOT NULL),
  said AS (SELECT DISTINCT CAST(row_id AS VARCHAR) AS id, i - 1 AS turn, messages[i].content AS content FROM (SELECT row_id, messages, unnest(range(1, len(messages) + 1)) AS i FROM release_rows)
    UNION ALL SELECT id || f, t, chr(10) || replace(x, ' ', '  ' || chr(13) || chr(10)) FROM texts WHERE t = 1 UNION ALL SELECT id || f, t, ' ' || x || ' ' || chr(13) || chr(10) || chr(9) FROM texts WHERE t > 1)
  SELECT id, CAST(turn AS INTEGER) AS turn FROM said WHERE sha256({STRIP.format("content")}) IN (SELECT h FROM held)""")
def heldout_exact_match(t):
    """Messages of release rows, and held-out texts with other white space around them (found) or within them (not found)."""
    texts = t.scenarios.select("id", F.posexplode("turns").alias("p", "x"))
    copies = texts.select("id", (F.col("p") + 1).alias("turn"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"x.{f}").alias("x")) for f in ("user", "expected")])).alias("e")).where("e.x IS NOT NULL")
    copies = copies.select(F.concat("id", "e.f").alias("id"), "turn", F.when(F.col("turn") == 1, F.concat(F.lit("\n"), F.replace("e.x", F.lit(" "), F.lit("  \r\n")))).otherwise(F.concat(F.lit(" "), "e.x", F.lit(" \r\n\t"))).alias("content"))
    held = references(t).select(F.sha2(stripped_lines(F.col("text")), 256).alias("h")).distinct()
    said = t.release_rows.select(F.col("row_id").cast("string").alias("id"), F.posexplode("messages").alias("turn", "m")).select("id", "turn", "m.content").union(copies)
    return said.select("id", "turn", F.sha2(stripped_lines(F.col("content")), 256).alias("h")).join(held, "h", "left_semi").select("id", "turn").distinct()


@query(f"WITH {FLAGS} SELECT id, CASE WHEN bool_or(severity = 'block') THEN 'block' WHEN count(severity) > 0 THEN 'review' ELSE 'pass' END AS decision, count(severity) AS flags FROM docs LEFT JOIN flagged USING (id) GROUP BY id")
def gate_decisions(t):
    own = documents(t)
    return gate.decisions(own, gate.text_flags(own, references(t)))


@query(f"WITH {FLAGS} SELECT code, severity, count(*) AS records FROM flagged GROUP BY code, severity")
def gate_summary(t):
    return gate.text_flags(documents(t), references(t)).groupBy("code", "severity").agg(F.count("*").alias("records"))


@query("""SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL)
  QUALIFY doc_id <> min(doc_id) OVER (PARTITION BY h)""")
def first_seen_duplicates(t):
    hashed = t.documents.where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("c")).where("c > 1").select("h", "first_id")
    return hashed.join(first, "h").where("doc_id <> first_id").select("doc_id", "first_id")


SECRETS = [("OpenAI-style API key", "sk-proj-" + "a1" * 12), ("Hugging Face token", "hf_" + "b2" * 12), ("TrueFoundry token", "tfy_" + "c3" * 12), ("GitHub token", "ghp_" + "d4" * 12), ("AWS access key", "AKIA" + "E5" * 8), ("private key", "-----BEGIN RSA " + "PRIVATE KEY-----")]
LEAKED = "CASE doc_id % 101 " + " ".join(f"WHEN {7 * k + 1} THEN ' {x}'" for k, (_, x) in enumerate(SECRETS)) + " ELSE '' END"


@query(f"SELECT doc_id, label FROM documents, (VALUES {', '.join(f'({7 * k + 1}, {n!r})' for k, (n, _) in enumerate(SECRETS))}) s(k, label) WHERE doc_id % 101 = k AND text IS NOT NULL")
def secret_scan(t):
    """Documents, some of which end in a string of each kind."""
    return t.documents.select("doc_id", F.explode(patterns.labels(F.concat("text", F.expr(LEAKED)))).alias("label"))


@query("SELECT doc_id, doc_id % 3 = 1 AS placeholder FROM documents WHERE doc_id % 13 = 2 AND text IS NOT NULL AND doc_id % 3 = 1")
def placeholder_scan(t):
    """Documents with a placeholder left in; half of the candidates get one."""
    own = t.documents.where("doc_id % 13 = 2 AND text IS NOT NULL").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 1, F.lit(" REPLACE_ME")).otherwise("")).alias("text"))
    return own.select("doc_id", F.col("text").rlike(patterns.PLACEHOLDER).alias("placeholder")).where("placeholder")


@query("SELECT doc_id AS id, 'notes/page ' || doc_id || '.md' AS target FROM documents WHERE doc_id % 5 = 0")
def local_links(t):
    return sinks.links(t.documents.where("doc_id % 5 = 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("see [it](notes/page%20"), "doc_id", F.lit(".md#top), [web](https://example.org/a) and [up](#top)")).alias("text")))


# Stated once more, not taken from the rule that it checks.
KEPT_BACK = "['.git', '.venv', '__pycache__', 'archived', 'credentials', 'data', 'outputs', 'private', 'scraped', 'secrets', 'zshots', 'zeval']"
PATH_SQL = "lower(coalesce(source, 'data') || '/' || coalesce(doc_kind, 'notes') || CASE WHEN doc_id % 7 = 0 THEN '/raw_transcript.' WHEN doc_id % 5 = 0 THEN '/.env.' ELSE '/text.' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.bin' ELSE '.txt' END)"


@query(f"""WITH paths AS (SELECT doc_id, {PATH_SQL} AS p FROM documents)
  SELECT * FROM (SELECT doc_id, CASE WHEN list_has_any(string_split(p, '/'), {KEPT_BACK}) THEN 'restricted directory'
    WHEN string_split(p, '/')[-1] LIKE '.env.%' THEN 'environment file' WHEN p LIKE '%raw_transcript%' THEN 'internal generation/review artifact'
    WHEN p LIKE '%.bin' THEN 'restricted binary or source payload' END AS reason FROM paths) WHERE reason IS NOT NULL""")
def restricted_path_reason(t):
    return t.documents.select("doc_id", patterns.restricted_reason(document_path()).alias("reason")).where("reason IS NOT NULL")


def document_path():
    """A path made of what a document tells of itself."""
    name = F.when(F.col("doc_id") % 7 == 0, "/raw_transcript.").when(F.col("doc_id") % 5 == 0, "/.env.").otherwise("/text.")
    return F.concat(F.coalesce("source", F.lit("data")), F.lit("/"), F.coalesce("doc_kind", F.lit("notes")), name, F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, ".bin").otherwise(".txt"))


@query(f"""WITH own AS (SELECT doc_id, {PATH_SQL} AS p, octet_length(encode(text)) AS n, doc_id % 101 AS k FROM documents)
  SELECT doc_id, 'restricted path' AS finding FROM own WHERE list_has_any(string_split(p, '/'), {KEPT_BACK}) OR string_split(p, '/')[-1] LIKE '.env.%' OR p LIKE '%raw_transcript%' OR p LIKE '%.bin'
  UNION ALL SELECT doc_id, 'file too large' FROM own WHERE n > 20000 UNION ALL SELECT doc_id, label FROM own JOIN (VALUES {', '.join(f'({7 * k + 1}, {n!r})' for k, (n, _) in enumerate(SECRETS))}) s(k, label) USING (k) WHERE n IS NOT NULL""")
def release_scan(t):
    """All findings of each file: why its path stays out, its size, and secrets in it."""
    own = t.documents.select("doc_id", document_path().alias("path"), F.octet_length("text").alias("n"), F.concat("text", F.expr(LEAKED)).alias("text"))
    path = F.when(patterns.restricted_reason(F.col("path")).isNotNull(), F.lit("restricted path"))
    large = F.when(F.col("n") > 20_000, F.lit("file too large"))
    found = F.concat(F.array_compact(F.array(path, large)), F.coalesce(patterns.labels(F.col("text")), F.array().cast("array<string>")))
    return own.select("doc_id", F.explode(found).alias("finding"))


@query(r"""SELECT doc_id, CAST(u.i AS INTEGER) AS sentence_no, s[u.i] AS sentence FROM (
    SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30) || '|\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL),
  LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) u""")
def sentence_split(t):
    return t.documents.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", (F.col("p") + 1).alias("sentence_no"), "sentence")


@query(f"""WITH {DOCS}, sized AS (SELECT d.doc_id, lower(replace(coalesce(source, 'none'), '-', '_')) AS source, len(w) AS n FROM documents d JOIN docs ON id = doc_id)
  SELECT source, count(*) AS documents, sum(n) AS words, max(n) AS longest, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95,
    count(*) FILTER (n > 128) AS over_128, CAST(sum(greatest(0, n - 128)) AS BIGINT) AS cut_at_128, count(*) FILTER (n > 512) AS over_512, CAST(sum(greatest(0, n - 512)) AS BIGINT) AS cut_at_512 FROM sized GROUP BY source""")
def length_threshold_report(t):
    sized = t.documents.select(F.lower(F.replace(F.coalesce("source", F.lit("none")), F.lit("-"), F.lit("_"))).alias("source"), F.size(tokens(F.col("text"))).alias("n"))
    over = [x for k in (128, 512) for x in (F.count_if(F.col("n") > k).alias(f"over_{k}"), F.sum(F.greatest(F.lit(0), F.col("n") - k)).alias(f"cut_at_{k}"))]
    return sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n").alias("words"), F.max("n").alias("longest"), F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.95).alias("p95"), *over)


@query(f"WITH {DOCS} SELECT id AS doc_id, len(w) AS words FROM docs ORDER BY words DESC, doc_id LIMIT 20")
def top_longest(t):
    return t.documents.select("doc_id", F.size(tokens(F.col("text"))).alias("words")).orderBy(F.desc("words"), "doc_id").limit(20)


@query(r"""SELECT doc_id, CASE WHEN length(c) <= 220 THEN c ELSE c[1:219] || '…' END AS excerpt, len(regexp_extract_all(text, '[^\s]+')) AS words
  FROM (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS c FROM documents WHERE text IS NOT NULL)""")
def document_excerpts(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", excerpt(F.col("text")).alias("excerpt"), space_words(F.col("text")).alias("words"))


@query("""SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, count(DISTINCT source_group_id) AS groups, count(DISTINCT subject) AS subjects, count(DISTINCT scenario_family) AS families FROM documents""")
def distinct_summary(t):
    return t.documents.agg(F.count("*").alias("documents"), *[F.countDistinct(c).alias(a) for c, a in (("source", "sources"), ("lang", "langs"), ("source_group_id", "groups"), ("subject", "subjects"), ("scenario_family", "families"))])
