"""Queries on texts and on the rules for single signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import rules, text as X
from lodestream.sources.tables import table

_R = lambda c, n=6: F.round(c, n)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_lit(i) for i in items) + "]"


_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]+"


def sql_terms(column: str) -> str:
    keep = rf"length(t) >= 3 AND NOT list_contains({_list(X.STOPWORDS)}, t) AND NOT contains(t, '://') AND NOT regexp_matches(t, '^[0-9][0-9.]*$') AND NOT regexp_matches(t, '^[-#]{{2,}}$') AND regexp_matches(t, '[\p{{L}}\p{{N}}]')"
    return f"list_distinct(list_filter(list_transform(string_split_regex(regexp_replace({column}, '<[^>]+>', ' ', 'g'), '{_SPACE}'), lambda t: trim(lower(t), {_lit(X.EDGE_CHARS)})), lambda t: {keep}))"


def sql_sentences(column: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({column}, '[.!?]+(?:\s|$)'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))), lambda s: s <> '')"


def sql_words(column: str) -> str:
    return rf"list_transform(list_filter(string_split_regex({column}, '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda w: regexp_matches(w, '^[a-zA-Z]+$')), lambda w: lower(w))"


def _match(pattern: str) -> str:
    return f"regexp_matches(s, {_lit(pattern)}, 'i')"


def terms_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(X.terms(F.col("text"))).alias("term"))


SQL = {"terms_per_doc": f"SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents WHERE text IS NOT NULL"}


def term_df_topk(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    return terms_per_doc(spark, sf_dir).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n_docs"), "term").limit(k)


SQL["term_df_topk"] = f"SELECT term, count(*) AS n_docs FROM ({SQL['terms_per_doc']}) GROUP BY term ORDER BY n_docs DESC, term LIMIT 100"


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.sentences(F.col("text")).alias("parts"))


def style_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style measures with ASCII word characters, as the SQL engine's patterns have them."""
    measures = X.style_measures(F.col("parts"), unicode=False)
    parts = _sentences(spark, sf_dir).select("doc_id", F.size("parts").alias("n_sentences"), *[c.alias(n) for n, c in measures.items() if n != "compression"])
    index = F.when(F.col("n_sentences") > 0, 0.3 * F.col("hedging") + 0.3 * F.col("passive") + 0.2 * F.col("nominal") + 0.2 * (1.0 - F.col("specificity"))).otherwise(0.0)
    index = F.greatest(F.lit(0.0), F.least(F.lit(1.0), index))
    return parts.select("doc_id", "n_sentences", *[_R(n).alias(n) for n in measures if n != "compression"], _R(index).alias("compression"))


_n = "len(p)"
_share = lambda pattern: f"(len(list_filter(p, lambda s: {_match(pattern)})) / {_n})"
SQL["style_index"] = f"""
WITH d AS (SELECT doc_id, {sql_sentences('text')} AS p FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, len(p) AS n_sentences,
  CASE WHEN len(p) > 0 THEN {_share(X.phrase_pattern(X.HEDGES))} ELSE 0.0 END AS hedging,
  CASE WHEN len(p) > 0 THEN {_share(X.PASSIVE)} ELSE 0.0 END AS passive,
  CASE WHEN len(p) > 0 THEN least(coalesce(list_sum(list_transform(p, lambda s: len(regexp_extract_all(s, {_lit(X.NOMINAL)}, 0, 'i')))), 0) / len(p), 1.0) ELSE 0.0 END AS nominal,
  CASE WHEN len(p) > 0 THEN {_share(X.CONCRETE)} ELSE 1.0 END AS specificity FROM d)
SELECT doc_id, n_sentences, round(hedging::DOUBLE, 6) AS hedging, round(passive::DOUBLE, 6) AS passive, round(nominal::DOUBLE, 6) AS nominal, round(specificity::DOUBLE, 6) AS specificity,
  round(CASE WHEN n_sentences > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE * hedging + 0.3::DOUBLE * passive + 0.2::DOUBLE * nominal + 0.2::DOUBLE * (1.0::DOUBLE - specificity))) ELSE 0.0::DOUBLE END, 6) AS compression FROM m"""


def style_index_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style measures with Unicode word characters (the default of the library)."""
    return _sentences(spark, sf_dir).select("doc_id", *[_R(c).alias(n) for n, c in X.style_measures(F.col("parts")).items()])


def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", X.words(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), _R(X.lexical_diversity(F.col("t"))).alias("lexical_diversity"), _R(X.token_entropy(F.col("t"))).alias("entropy"))


SQL["token_statistics"] = rf"""
WITH d AS (SELECT doc_id, {sql_words('text')} AS t FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, sum(-(n / total) * log2(n / total)) AS h FROM (SELECT doc_id, w, count(*)::DOUBLE AS n, any_value(total)::DOUBLE AS total FROM (SELECT doc_id, len(t) AS total, unnest(t) AS w FROM d) GROUP BY doc_id, w) GROUP BY doc_id)
SELECT doc_id, len(t) AS n_tokens, round(CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0.0::DOUBLE END, 6) AS lexical_diversity, round(coalesce(h, 0.0::DOUBLE), 6) AS entropy FROM d LEFT JOIN e USING (doc_id)"""


def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("doc_id", _R(X.temporal_orientation(F.col("parts"), unicode=False)).alias("orientation"))


SQL["orientation"] = f"""
WITH d AS (SELECT doc_id, {sql_sentences('text')} AS p FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, len(list_filter(p, lambda s: {_match(X.phrase_pattern(X.FORWARD))})) AS f, len(list_filter(p, lambda s: {_match(X.phrase_pattern(X.BACKWARD))})) AS b FROM d)
SELECT doc_id, round(CASE WHEN f + b > 0 THEN (f - b) / (f + b) ELSE 0.0::DOUBLE END, 6) AS orientation FROM m"""


def sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split(F.lower("text"), _SPACE).alias("t"))
    s = X.sentiment(F.col("t"))
    return docs.select("doc_id", _R(s["polarity"]).alias("polarity"), _R(s["magnitude"]).alias("magnitude"), s["label"].alias("label"))


SQL["sentiment_scores"] = f"""
WITH d AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '{_SPACE}')) AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, len(list_intersect(t, {_list(X.POSITIVE_WORDS)})) AS p, len(list_intersect(t, {_list(X.NEGATIVE_WORDS)})) AS n FROM d),
s AS (SELECT doc_id, p + n AS total, CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0::DOUBLE END AS polarity, CASE WHEN p + n > 0 THEN least(1.0::DOUBLE, (p + n) / 5) ELSE 0.0::DOUBLE END AS magnitude FROM m)
SELECT doc_id, round(polarity, 6) AS polarity, round(magnitude, 6) AS magnitude, CASE WHEN total = 0 THEN 'neutral' WHEN polarity > 0.2 THEN 'positive' WHEN polarity < -0.2 THEN 'negative' WHEN magnitude > 0.3 THEN 'mixed' ELSE 'neutral' END AS label FROM s"""


def _signals(spark, sf_dir):
    return table(spark, sf_dir, "signals")


_META = "get_json_object(metadata, '$.%s')"


def _meta(key: str):
    return F.get_json_object("metadata", f"$.{key}")


def _labels():
    return F.from_json("metadata", "labels array<string>")["labels"]


def _sql_meta(key: str) -> str:
    return f"CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.{key}') END"


def constraint_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return _signals(spark, sf_dir).where("content IS NOT NULL").select("delivery_no", rules.constraint_action(c).alias("action"), F.array_join(rules.fired_categories(c), ",").alias("categories"))


_fires = [(f"regexp_matches(content, {_lit(p)}, 'i')", c) for p, c in rules.KILL_PATTERNS] + [(f"regexp_matches(content, {_lit(p)}, 'i')", c) for p, _, c in rules.REDACT_PATTERNS]
_kill = " OR ".join(f for f, _ in _fires[: len(rules.KILL_PATTERNS)])
_redact = " OR ".join(f for f, _ in _fires[len(rules.KILL_PATTERNS) :])
_cats = "list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {f} THEN {_lit(c)} END" for f, c in _fires) + "], lambda x: x IS NOT NULL)))"
SQL["constraint_actions"] = f"SELECT delivery_no, CASE WHEN {_kill} THEN 'kill' WHEN {_redact} THEN 'redact' ELSE 'pass' END AS action, coalesce(array_to_string({_cats}, ','), '') AS categories FROM signals WHERE content IS NOT NULL"


def constraint_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _signals(spark, sf_dir).where("content IS NOT NULL").select("source", F.explode(rules.fired_categories(F.col("content"))).alias("category"))
    return hits.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n"))


SQL["constraint_counts"] = f"SELECT source, category, count(*) AS n FROM (SELECT source, unnest({_cats}) AS category FROM signals WHERE content IS NOT NULL) GROUP BY source, category"


def constraint_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("content")
    return _signals(spark, sf_dir).where("content IS NOT NULL").where(rules.kill_category(c).isNull()).select("delivery_no", rules.redacted(c).alias("content"))


_red = "content"
for _p, _r, _c in rules.REDACT_PATTERNS:
    _red = f"regexp_replace({_red}, {_lit(_p)}, {_lit(_r)}, 'gi')"
SQL["constraint_redacted"] = f"SELECT delivery_no, {_red} AS content FROM signals WHERE content IS NOT NULL AND NOT ({_kill})"


def noise_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).where(~rules.is_noise(F.col("content"), _meta("subtype"))).groupBy("source").agg(F.count(F.lit(1)).alias("n_kept"), F.max("delivery_no").alias("last_no"))


_flat = "trim(content, ' ' || chr(9) || chr(10) || chr(13))"
_noise = rf"""content IS NULL OR {_flat} = '' OR NOT regexp_matches({_flat}, '[\p{{L}}\p{{N}}]') OR (length({_flat}) <= 16 AND list_contains({_list(rules.ACKS)}, trim(lower({_flat}), ' ' || chr(9) || chr(10) || {_lit(rules.ACK_EDGES.replace(chr(9), '').replace(chr(10), ''))})))
 OR coalesce(list_contains({_list(rules.SYSTEM_SUBTYPES)}, {_sql_meta('subtype')}), false)"""
SQL["noise_filter"] = f"SELECT source, count(*) AS n_kept, max(delivery_no) AS last_no FROM signals WHERE NOT ({_noise}) GROUP BY source"


def domain_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir).where("content IS NOT NULL").select("delivery_no", "source", "channel", X.terms(F.col("content")).alias("t"), _labels().alias("labels"))
    return s.select("delivery_no", rules.domain(F.col("t"), F.col("source"), F.col("channel"), F.col("labels")).alias("domain"))


def _sql_domain() -> str:
    scores = []
    for name, (kw, src, ch) in rules.DOMAIN_HINTS.items():
        s = f"0.2::DOUBLE * len(list_intersect(t, {_list(kw)}))"
        if src:
            s += f" + CASE WHEN list_contains({_list(src)}, source) THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"
        s += f" + 0.1::DOUBLE * len(list_intersect(labels, {_list(kw)}))"
        s += " + CASE WHEN " + " OR ".join(f"contains(coalesce(lower(channel), ''), {_lit(c)})" for c in ch) + " THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END"
        scores.append((name, s))
    cols = ", ".join(f"{s} AS {n}" for n, s in scores)
    best = "greatest(" + ", ".join(n for n, _ in scores) + ")"
    case = "CASE WHEN " + best + " = 0 THEN 'general' " + " ".join(f"WHEN {n} = {best} THEN '{n}'" for n, _ in scores) + " END"
    return f"WITH d AS (SELECT delivery_no, source, channel, {sql_terms('content')} AS t, list_distinct(list_transform(coalesce(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.labels[*]'), []::VARCHAR[]), lambda l: lower(l))) AS labels FROM signals WHERE content IS NOT NULL), s AS (SELECT delivery_no, {cols} FROM d) SELECT delivery_no, {case} AS domain FROM s"


SQL["domain_inference"] = _sql_domain()


def credibility_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = F.coalesce(_meta("additions").try_cast("bigint"), F.lit(0)) + F.coalesce(_meta("deletions").try_cast("bigint"), F.lit(0))
    s = _signals(spark, sf_dir).select("delivery_no", "source", F.coalesce(_meta("event_type"), F.lit("")).alias("event_type"), diff.alias("diff"))
    return s.select("delivery_no", "event_type", _R(rules.credibility(F.col("event_type"), F.col("source"), F.col("diff"))).alias("credibility"))


SQL["credibility_scores"] = f"""
WITH s AS (SELECT delivery_no, source, coalesce({_sql_meta('event_type')}, '') AS event_type, coalesce(try_cast({_sql_meta('additions')} AS BIGINT), 0) + coalesce(try_cast({_sql_meta('deletions')} AS BIGINT), 0) AS diff FROM signals),
b AS (SELECT *, CASE WHEN list_contains({_list(rules.COSTLY_EVENTS)}, event_type) THEN 0.8::DOUBLE WHEN list_contains({_list(rules.CHEAP_EVENTS)}, event_type) THEN 0.2::DOUBLE WHEN source = 'github' THEN 0.6::DOUBLE WHEN source = 'linear' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END AS base FROM s)
SELECT delivery_no, event_type, round(CASE WHEN diff > 0 THEN least(1.0::DOUBLE, base + least(0.2::DOUBLE, 0.05::DOUBLE * log10(greatest(diff, 1)::DOUBLE))) ELSE base END, 6) AS credibility FROM b"""


def mention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir).where("content IS NOT NULL AND author IS NOT NULL")
    return s.select("author", F.explode(X.mentions(F.col("content"), F.col("author"))).alias("mentioned")).groupBy("author", "mentioned").agg(F.count(F.lit(1)).alias("n"))


SQL["mention_edges"] = r"SELECT author, mentioned, count(*) AS n FROM (SELECT author, unnest(list_distinct(regexp_extract_all(content, '@(\w[\w.-]*)', 1))) AS mentioned FROM signals WHERE content IS NOT NULL AND author IS NOT NULL) WHERE mentioned <> author GROUP BY author, mentioned"


def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").where("name IS NOT NULL")
    p = X.name_profile(F.col("name"))
    return e.select("entity_id", X.company_key(F.col("name")).alias("company_key"), p["n_words"].alias("n_words"), _R(p["entropy"]).alias("entropy"), _R(p["generic_ratio"]).alias("generic_ratio"))


_tok = r"list_filter(string_split_regex(lower(regexp_replace(name, '[^\p{L}\p{N}\s]', ' ', 'g')), '\s+'), lambda t: length(t) > 1)"
SQL["company_keys"] = rf"""
WITH e AS (SELECT entity_id, name, {_tok} AS t FROM entities WHERE name IS NOT NULL),
h AS (SELECT entity_id, sum(-(n / total) * log2(n / total)) AS h FROM (SELECT entity_id, w, count(*)::DOUBLE AS n, any_value(total)::DOUBLE AS total FROM (SELECT entity_id, len(t) AS total, unnest(t) AS w FROM e) GROUP BY entity_id, w) GROUP BY entity_id)
SELECT entity_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), {_lit(X.LEGAL_SUFFIX)}, '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS company_key, len(t) AS n_words,
  round(coalesce(h, 0.0::DOUBLE), 6) AS entropy, round(CASE WHEN len(t) > 0 THEN len(list_filter(t, lambda x: list_contains({_list(X.GENERIC_NAME_WORDS)}, x))) / len(t) ELSE 0.0::DOUBLE END, 6) AS generic_ratio FROM e LEFT JOIN h USING (entity_id)"""


def content_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir).where("content IS NOT NULL")
    return s.select("delivery_no", X.finding_hash(F.coalesce("source", F.lit("")), F.col("content"), F.array_compact(F.array("author"))).alias("finding_hash"), X.content_hash([F.col("source"), F.col("channel")]).alias("resource_key"))


_low = "lower(trim(content, ' '))"
_named = lambda pattern, group: f"array_to_string(list_sort(list_distinct(regexp_extract_all({_low}, '{pattern}', {group}))), ',')"
_PR, _AT = r"pr\s*#([0-9]+)", r"@([\p{L}\p{N}_-]+)"
SQL_FINDING = f"""substr(sha256(regexp_replace(lower(trim(coalesce(source, ''), ' ')), '[ -]', '_', 'g') || ':' || array_to_string(list_sort(list_distinct(list_filter(string_split_regex(substr({_low}, 1, 120), '[^a-z0-9]+'), lambda w: length(w) >= 3))), ' ')
  || ':' || coalesce(lower(trim(author, ' ')), '') || ':' || {_named(_PR, 1)} || ':' || {_named('[a-z]+-[0-9]+', 0)} || ':' || {_named(_AT, 1)}), 1, 16)"""
SQL["content_addresses"] = f"SELECT delivery_no, {SQL_FINDING} AS finding_hash, substr(sha256(concat_ws(':', source, channel)), 1, 16) AS resource_key FROM signals WHERE content IS NOT NULL"


def code_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.explode(X.code_tokens(F.col("text"))).alias("token"))
    return d.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


SQL["code_vocabulary"] = r"SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(regexp_replace(text, '[._/\\-]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '\s+'), lambda t: length(t) >= 2)) AS token FROM documents WHERE text IS NOT NULL) GROUP BY token"


def inquiry_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signals(spark, sf_dir).where("content IS NOT NULL")
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Z]{2,}-\d+|#\d{2,}|GH-\d+"), F.lit(0))))
    projects = F.array_sort(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[\w-]+/[\w.-]+|(?:project|repo|service|module)[\s:]+[\w.-]+"), F.lit(0))))
    return s.select("delivery_no", F.array_join(found, ",").alias("tickets"), F.array_join(projects, ",").alias("projects"))


SQL["inquiry_tickets"] = r"""SELECT delivery_no, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(content, '[A-Z]{2,}-\d+|#\d{2,}|GH-\d+'))), ','), '') AS tickets,
  coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(content, '[\w-]+/[\w.-]+|(?:project|repo|service|module)[\s:]+[\w.-]+'))), ','), '') AS projects FROM signals WHERE content IS NOT NULL"""


QUERIES = {f.__name__: f for f in (terms_per_doc, term_df_topk, style_index, style_index_unicode, token_statistics, orientation, sentiment_scores, constraint_actions, constraint_counts, constraint_redacted, noise_filter, domain_inference, credibility_scores, mention_edges, company_keys, content_addresses, code_vocabulary, inquiry_tickets)}
