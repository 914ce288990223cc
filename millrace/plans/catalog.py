"""All queries over the engine's own operators and their SQL twins, by name."""

from __future__ import annotations

from millrace.functions import hashing, numeric, privacy, quality, text
from millrace.operators import clean, constraints, dedupe, enrich, lineage, profile, report, shape, sketches, vectors
from millrace.plans import pipeline, roundtrips  # noqa: F401  registers the queries over sources, sinks, jobs and streams
from millrace.plans.registry import ORACLES, QUERIES, query
from millrace.runtime import cut, scratch, spread
from pyspark.sql import functions as F

__all__ = ["ORACLES", "QUERIES"]

# -------------------------------------------------------------- duplicates

_NORMAL = "regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"


def _normal(c):
    return F.regexp_replace(text.strip(F.lower(c)), r"\s+", " ")


@query(f"""SELECT doc_id, lang, source, n_chars, row_hash FROM (
  SELECT *, md5({_NORMAL}) AS row_hash, row_number() OVER (PARTITION BY md5({_NORMAL}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def exact_dedupe_keep_first(t):
    docs = t("documents").withColumn("row_hash", hashing.joined_hash([_normal(F.col("text"))]))
    return dedupe.keep_first(docs.drop("text"), F.col("row_hash"), "doc_id").select("doc_id", "lang", "source", "n_chars", "row_hash")


@query(f"""WITH h AS (SELECT doc_id, md5({_NORMAL}) AS row_hash FROM documents)
SELECT row_hash, min(doc_id) AS first_seen_row FROM h WHERE doc_id % 2 = 1 AND row_hash NOT IN (SELECT row_hash FROM h WHERE doc_id % 2 = 0) GROUP BY row_hash""")
def incremental_dedupe_anti_join(t):
    rows = t("documents").select("doc_id", hashing.joined_hash([_normal(F.col("text"))]).alias("h"))
    state = dedupe.keep_first(rows.filter("doc_id % 2 = 0"), F.col("h"), "doc_id").select(F.col("h").alias("row_hash"), F.col("doc_id").alias("first_seen_row"))
    return dedupe.new_rows(rows.filter("doc_id % 2 = 1"), state, F.col("h"), "doc_id")[1]


@query("""SELECT min(p_partkey) AS p_partkey, count(*) AS copies FROM part GROUP BY p_brand, p_size, p_type""")
def row_hash_exclude_id(t):
    part = t("part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", "p_type")
    return part.withColumn("h", hashing.content_hash(part)).groupBy("h").agg(F.min("id").alias("p_partkey"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("""SELECT n_nationkey, md5(concat_ws('|', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR)) AS row_hash FROM nation""")
def row_hash_columns(t):
    nation = t("nation")
    return nation.select("n_nationkey", hashing.joined_hash([F.col(c) for c in nation.columns]).alias("row_hash"))


# -------------------------------------------------- shingles and signatures


def _customers(t):
    c = t("customer")
    return c.withColumn("snippet", text.snippet([c.c_custkey, c.c_name, c.c_nationkey]))


_CUSTOMER = "c AS (SELECT c_custkey, concat_ws(' ', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR) AS s FROM customer)"
_SHINGLES = "sh AS (SELECT c_custkey, list_distinct([lower(s)[i:i + 4] FOR i IN range(1, greatest(len(s) - 3, 1))]) AS x FROM c)"
_SIGNATURES = """e AS (SELECT c_custkey, unnest(x) AS g FROM sh), k AS (SELECT unnest(range(64)) AS k),
m AS (SELECT c_custkey, k, min(sha256(g || '|' || k::VARCHAR)[1:16]) AS h FROM e, k GROUP BY c_custkey, k),
sig AS (SELECT c_custkey, list(CAST(('0x' || h)::UBIGINT AS VARCHAR) ORDER BY k) AS sig FROM m GROUP BY c_custkey)"""
_BUCKETS = "b AS (SELECT c_custkey, unnest([md5('[' || array_to_string(sig[i * 4 + 1:i * 4 + 4], ', ') || ']') FOR i IN range(16)]) AS bucket_key FROM sig)"


@query(f"WITH {_CUSTOMER}, {_SHINGLES} SELECT c_custkey, len(x) AS n, array_to_string(list_sort(x), '~') AS shingles FROM sh")
def shingles(t):
    return _customers(t).select("c_custkey", hashing.shingles(F.col("snippet")).alias("x")).select("c_custkey", F.size("x").cast("long").alias("n"), F.array_join(F.array_sort("x"), "~").alias("shingles"))


@query(f"WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES} SELECT c_custkey, array_to_string(sig, ',') AS signature FROM sig")
def minhash_signatures(t):
    return spread(_customers(t)).select("c_custkey", F.array_join(hashing.minhash(hashing.shingles(F.col("snippet"))), ",").alias("signature"))


@query(f"WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES}, {_BUCKETS} SELECT c_custkey, bucket_key FROM b")
def lsh_buckets(t):
    return spread(_customers(t)).select("c_custkey", F.explode_outer(hashing.lsh_buckets(hashing.minhash(hashing.shingles(F.col("snippet"))))).alias("bucket_key"))


@query(f"WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES} SELECT c_custkey, 'bucket_' || (sig[1]::UBIGINT % 100)::VARCHAR AS bucket FROM sig")
def lsh_bucket_key(t):
    return _customers(t).select("c_custkey", hashing.bucket_key(hashing.minhash(hashing.shingles(F.col("snippet")), 1)).alias("bucket"))


_PAIRS = "p AS (SELECT DISTINCT b.c_custkey AS row_id, s.c_custkey AS candidate_id FROM b JOIN b AS s ON b.bucket_key = s.bucket_key WHERE s.c_custkey % 50 = 0 AND b.c_custkey <> s.c_custkey)"


@query(f"WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES}, {_BUCKETS}, {_PAIRS} SELECT * FROM p")
def near_dup_candidates(t):
    return dedupe.candidate_pairs(_customers(t), F.col("snippet"), "c_custkey")


@query(f"""WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES}, {_BUCKETS}, {_PAIRS}
SELECT row_id, candidate_id, round(len(list_intersect(a.x, d.x)) / len(list_distinct(list_concat(a.x, d.x))), 9) AS similarity FROM p
JOIN sh a ON a.c_custkey = row_id JOIN sh d ON d.c_custkey = candidate_id WHERE len(list_intersect(a.x, d.x)) / len(list_distinct(list_concat(a.x, d.x))) >= 0.6""")
def near_dup_jaccard(t):
    return dedupe.near_duplicates(_customers(t), F.col("snippet"), "c_custkey", None, 0.6, "jaccard").withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES}, {_BUCKETS}, {_PAIRS}
SELECT row_id, candidate_id, round(1 - levenshtein(a.s, d.s) / greatest(len(a.s), len(d.s), 1), 9) AS similarity FROM p
JOIN c a ON a.c_custkey = row_id JOIN c d ON d.c_custkey = candidate_id WHERE 1 - levenshtein(a.s, d.s) / greatest(len(a.s), len(d.s), 1) >= 0.85""")
def near_dup_levenshtein(t):
    rows = _customers(t)
    samples = cut(dedupe.lsh_samples(rows, F.col("snippet"), "c_custkey"))
    return dedupe.near_duplicates(rows, F.col("snippet"), "c_custkey", samples, 0.85, "levenshtein").withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES}, {_BUCKETS}, g AS (SELECT bucket_key, min(c_custkey) AS representative_id FROM b WHERE c_custkey % 50 = 0 GROUP BY 1),
p AS (SELECT DISTINCT c_custkey AS row_id, representative_id FROM b JOIN g USING (bucket_key) WHERE c_custkey <> representative_id)
SELECT row_id, representative_id, round(len(list_intersect(a.x, d.x)) / len(list_distinct(list_concat(a.x, d.x))), 9) AS similarity FROM p
JOIN sh a ON a.c_custkey = row_id JOIN sh d ON d.c_custkey = representative_id WHERE len(list_intersect(a.x, d.x)) / len(list_distinct(list_concat(a.x, d.x))) >= 0.4""")
def near_dup_groups(t):
    return dedupe.near_groups(_customers(t), F.col("snippet"), "c_custkey", 0.4, "jaccard").withColumn("similarity", F.round("similarity", 9))


#: The matching-blocks ratio of pairs p (row_id, candidate_id, a, b): the longest block that both texts share (the first in a, then in b), and the same left and right of it.
_RATIO = """t(row_id, candidate_id, s, a, b, n) AS (SELECT row_id, candidate_id, 0::HUGEINT, a, b, 0 FROM p UNION ALL
 SELECT row_id, candidate_id, unnest([2 * s + 1, 2 * s + 2]), unnest([a[1:m.i - 1], a[m.i + m.k:]]), unnest([b[1:m.j - 1], b[m.j + m.k:]]), unnest([m.k, 0])
 FROM (SELECT row_id, candidate_id, s, a, b, min({'o': -k, 'i': i, 'j': j, 'k': k}) AS m FROM (
   SELECT *, unnest(range(1, least(len(a) - i, len(b) - j) + 2)) AS k FROM (SELECT *, unnest(range(1, len(b) + 1)) AS j FROM (SELECT row_id, candidate_id, s, a, b, unnest(range(1, len(a) + 1)) AS i FROM t WHERE a <> '' AND b <> '')) WHERE a[i] = b[j])
   WHERE a[i:i + k - 1] = b[j:j + k - 1] GROUP BY row_id, candidate_id, s, a, b)),
q AS (SELECT p.row_id, p.candidate_id, CASE WHEN p.a = '' AND p.b = '' THEN 1 ELSE 2 * coalesce(sum(n), 0) / (len(p.a) + len(p.b)) END AS ratio FROM p LEFT JOIN t ON p.row_id = t.row_id AND p.candidate_id = t.candidate_id GROUP BY p.row_id, p.candidate_id, p.a, p.b)"""


@query(f"""WITH RECURSIVE {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES}, {_BUCKETS}, {_PAIRS.replace("p AS", "w AS")},
p AS (SELECT row_id, candidate_id, x.s AS a, y.s AS b FROM w JOIN c x ON x.c_custkey = row_id JOIN c y ON y.c_custkey = candidate_id), {_RATIO}
SELECT row_id, candidate_id, round(ratio, 9) AS similarity FROM q WHERE ratio >= 0.85""")
def near_dup_ratio(t):
    return dedupe.near_duplicates(_customers(t), F.col("snippet"), "c_custkey", None, 0.85, "ratio").withColumn("similarity", F.round("similarity", 9))


# --------------------------------------------------------------- text cells


@query(r"""SELECT p_partkey, regexp_replace(p_name, '^\s+|\s+$', '', 'g') AS stripped, lower(p_type) AS lowered, regexp_replace(lower(p_brand), '[^\p{L}\p{M}\p{N}_\s]', '', 'g') AS no_punctuation FROM part""")
def text_normalize(t):
    return t("part").select("p_partkey", text.strip(F.col("p_name")).alias("stripped"), text.lower_text(F.col("p_type")).alias("lowered"), text.lower_text(F.col("p_brand"), False).alias("no_punctuation"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '^[^\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+$', '', 'g')) AS cleaned_md5 FROM documents""")
def clean_text(t):
    return t("documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("cleaned_md5"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS token_count FROM documents""")
def token_count(t):
    return t("documents").select("doc_id", text.token_count(F.col("text")).alias("token_count"))


@query("""SELECT c_custkey, concat_ws(' ', c_custkey::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN 'nan' ELSE c_name END, c_nationkey::VARCHAR) AS snippet FROM customer""")
def row_snippet(t):
    c = t("customer").withColumn("c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")))
    return c.select("c_custkey", text.snippet([c.c_custkey, c.c_name, c.c_nationkey]).alias("snippet"))


# ------------------------------------------------------------ numeric cells

_FLOAT = r"'^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$'"
_MIXED = "CASE event_id % 6 WHEN 0 THEN ' ' || event_id || '.5 ' WHEN 1 THEN '$1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') WHEN 2 THEN '(' || (event_id % 97) || ')' WHEN 3 THEN (event_id % 100) || '%' WHEN 4 THEN event_type ELSE '1e' || (event_id % 9) END"


def _mixed():
    i = F.col("event_id")
    forms = [F.concat(F.lit(" "), i, F.lit(".5 ")), F.concat(F.lit("$1,"), F.lpad((i % 1000).cast("string"), 3, "0")), F.concat(F.lit("("), i % 97, F.lit(")")), F.concat(i % 100, F.lit("%")), F.col("event_type"), F.concat(F.lit("1e"), i % 9)]
    out = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        out = F.when(i % 6 == k, form).otherwise(out)
    return out


@query(rf"""WITH v AS (SELECT event_id, {_MIXED} AS raw FROM events), e AS (SELECT *, replace(regexp_replace(replace(replace(regexp_replace(trim(raw), '%$', ''), '(', '-'), ')', ''), '[^0-9eE+\-.,]', '', 'g'), ',', '') AS z FROM v)
SELECT event_id, raw, regexp_matches(trim(raw), {_FLOAT}) AS numeric_like, regexp_matches(regexp_replace(raw, '[,$€£%() ]', '', 'g'), {_FLOAT}) AS looks_numeric, CASE WHEN regexp_matches(z, {_FLOAT}) THEN TRY_CAST(z AS DOUBLE) END AS parsed FROM e""")
def numeric_parse(t):
    return t("events").select("event_id", _mixed().alias("raw")).select("event_id", "raw", numeric.numeric_like(F.col("raw")).alias("numeric_like"), numeric.looks_numeric(F.col("raw")).alias("looks_numeric"), numeric.parse_enhanced(F.col("raw")).alias("parsed"))


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS value FROM events""")
def numeric_finite(t):
    v = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 1, F.lit(float("-inf"))).otherwise(F.col("value"))
    return t("events").select("event_id", numeric.finite(v).alias("value"))


# ----------------------------------------------------------------- profiles


@query("""SELECT count(*) AS n_rows, round(avg(value), 6) AS mean_value FROM events""")
def row_count_and_mean(t):
    return t("events").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(rf"""WITH s AS (SELECT * FROM events WHERE event_id % 10 = 0), c AS (
  SELECT 'event_type' AS "column", event_type AS v FROM s UNION ALL SELECT 'user_id', user_id::VARCHAR FROM s UNION ALL SELECT 'raw', {_MIXED} FROM s)
SELECT "column", count(*) AS n_sampled, sum(CASE WHEN regexp_matches(trim(v), {_FLOAT}) THEN 1 ELSE 0 END)::BIGINT AS n_numeric, sum(CASE WHEN regexp_matches(trim(v), {_FLOAT}) THEN 1 ELSE 0 END) / count(*) >= 0.5 AS is_numeric FROM c GROUP BY 1""")
def numeric_vote(t):
    return profile.type_votes(t("events").withColumn("raw", _mixed()), ["event_type", "user_id", "raw"], "event_id")


_FEW = """r AS (SELECT "column", row_id, value, substring(sha256("column" || '_v1|' || row_id::VARCHAR), 1, 16) AS priority FROM (
  SELECT 'event_type' AS "column", event_id AS row_id, event_type AS value FROM events UNION ALL SELECT 'user_id', event_id, user_id::VARCHAR FROM events)
  QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY priority, row_id) <= 500)"""
_RESERVOIR = _FEW.replace("<= 500", f"<= {profile.CAPACITY}")


@query(f"WITH {_RESERVOIR} SELECT * FROM r")
def reservoir_bottom_k(t):
    return profile.reservoir(t("events"), ["event_type", "user_id"], "event_id").select("column", "row_id", "value", "priority")


@query(f"WITH {_FEW} SELECT * FROM r")
def reservoir_of_500(t):
    """With fewer places than rows at every scale of the tables at hand."""
    return profile.reservoir(t("events"), ["event_type", "user_id"], "event_id", 500).select("column", "row_id", "value", "priority")


@query(f"""WITH {_RESERVOIR} SELECT "column", quantile_cont(value::DOUBLE, 0.5) AS median FROM r WHERE "column" = 'user_id' GROUP BY 1""")
def sampled_median(t):
    return profile.medians(profile.reservoir(t("events"), ["user_id"], "event_id"))


@query(f"""WITH {_RESERVOIR} SELECT "column", value AS mode FROM (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS n FROM r GROUP BY 1, 2) WHERE n = 1""")
def mode_lowest(t):
    return profile.modes_lowest(profile.reservoir(t("events"), ["event_type", "user_id"], "event_id"))


@query("""WITH c AS (SELECT 'o_orderpriority' AS "column", o_orderkey AS i, lower(trim(o_orderpriority)) AS v FROM orders WHERE o_orderkey % 20 = 0
 UNION ALL SELECT 'o_custkey', o_orderkey, o_custkey::VARCHAR FROM orders WHERE o_orderkey % 20 = 0)
SELECT "column", v AS mode FROM (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, min(i)) AS n FROM c GROUP BY 1, 2) WHERE n = 1""")
def mode_first_seen(t):
    return profile.modes_first_seen(t("orders"), ["o_orderpriority", "o_custkey"], "o_orderkey")


@query("""SELECT 'o_totalprice' AS "column", round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.75), 6) AS q3 FROM orders
UNION ALL SELECT 'o_custkey', round(quantile_cont(o_custkey::DOUBLE, 0.25), 6), round(quantile_cont(o_custkey::DOUBLE, 0.75), 6) FROM orders""")
def quartiles(t):
    return profile.quartiles(t("orders"), ["o_totalprice", "o_custkey"]).select("column", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


@query("""SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS n_distinct, count(*) AS n_rows FROM lineitem
UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), count(*) FROM lineitem UNION ALL SELECT 'l_shipdate', count(DISTINCT l_shipdate), count(*) FROM lineitem""")
def distinct_counts(t):
    return profile.distinct_counts(t("lineitem"), ["l_returnflag", "l_partkey", "l_shipdate"])


@query("""WITH c AS (SELECT 'l_returnflag' AS "column", l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_orderkey', l_orderkey::VARCHAR FROM lineitem UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem),
g AS (SELECT "column", count(DISTINCT v) / count(*) AS u, avg(CASE WHEN v SIMILAR TO '[0-9]+' THEN 1 ELSE 0 END) AS r FROM c GROUP BY 1)
SELECT "column", round(u, 9) AS unique_ratio, round(r, 9) AS numeric_ratio, CASE WHEN u < 0.05 THEN 'categorical' WHEN r >= 0.9 THEN 'numeric' END AS suggestion FROM g""")
def unique_ratio_class(t):
    return profile.column_classes(t("lineitem"), ["l_returnflag", "l_orderkey", "l_linenumber"]).withColumns({"unique_ratio": F.round("unique_ratio", 9), "numeric_ratio": F.round("numeric_ratio", 9)})


@query(rf"""WITH v AS (SELECT 'raw' AS "column", {_MIXED} AS raw FROM events UNION ALL SELECT 'event_type', event_type FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR FROM events),
e AS (SELECT "column", replace(regexp_replace(replace(replace(regexp_replace(trim(raw), '%$', ''), '(', '-'), ')', ''), '[^0-9eE+\-.,]', '', 'g'), ',', '') AS z FROM v)
SELECT "column", round(avg(CASE WHEN regexp_matches(z, {_FLOAT}) THEN 1 ELSE 0 END), 9) AS numeric_ratio, avg(CASE WHEN regexp_matches(z, {_FLOAT}) THEN 1 ELSE 0 END) >= 0.7 AS is_numeric FROM e GROUP BY 1""")
def numeric_candidates(t):
    return profile.numeric_candidates(t("events").withColumn("raw", _mixed()), ["raw", "event_type", "user_id"]).withColumn("numeric_ratio", F.round("numeric_ratio", 9))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 = 0 ORDER BY o_orderkey LIMIT 1000""")
def head_sample(t):
    return shape.head(t("orders"), "o_orderkey", 1000, 10).select("o_orderkey", "o_orderstatus")


_STATE = """SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS n_values, count(DISTINCT {c}) AS n_distinct, {q}, (SELECT {c}::VARCHAR FROM v WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
 (SELECT count(*) FROM v WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS mode_count FROM v"""
_QUANTILES = ", ".join(f"quantile_disc({{c}}, {s / 100})::DOUBLE AS q{s}" for s in (25, 50, 75))


@query("WITH v AS (SELECT event_type, CASE WHEN event_id % 9 > 0 THEN floor(value / 5)::INT END AS step FROM events) " + _STATE.format(c="event_type", q="NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75") + " UNION ALL " + _STATE.format(c="step", q=_QUANTILES.format(c="step")))
def merged_profile(t):
    """Profiles of three parts of a table, kept as states and merged without their rows; exact as a state holds all of the few distinct values and 32,768 ranks."""
    step = F.when(F.col("event_id") % 9 > 0, F.floor(F.col("value") / 5).cast("int"))
    rows = t("events").select("event_id", "event_type", step.alias("step"))
    store = sketches.ProfileStore(t.spark, f"{scratch(t.spark)}/profile", 32_768)
    for part in range(3):
        store.add(rows.filter(F.col("event_id") % 3 == part), ["event_type", "step"])
    return store.profile()


# ----------------------------------------------------------------- cleaning

_HOLES = "h AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS event_type FROM events)"


def _holes(t):
    i = F.col("event_id")
    return t("events").select("event_id", F.when(i % 7 != 0, F.col("value")).alias("value"), F.when(i % 11 == 0, None).when(i % 13 == 0, "").otherwise(F.col("event_type")).alias("event_type"))


def _hole_stats(t):
    rows = _holes(t)
    value = profile.quantiles(rows, ["value"], [0.5])["value"][0]
    modes = profile.as_dict(profile.modes_first_seen(rows, ["event_type", "value"], "event_id"))
    return {"value": {"median": value, "mode": modes["value"]["mode"]}, "event_type": {"mode": modes["event_type"]["mode"]}}


_MODE = "(SELECT v FROM (SELECT lower(trim({c}::VARCHAR)) AS v, min(event_id) AS i, count(*) AS n FROM h WHERE event_id % 20 = 0 AND {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, i LIMIT 1)"


@query(f"""WITH {_HOLES}, m AS (SELECT quantile_cont(value, 0.5) AS x FROM h)
SELECT event_id, coalesce(value, (SELECT x FROM m)) AS value, coalesce(event_type, {_MODE.format(c="event_type")}) AS event_type, value IS NULL AS value_was_imputed, event_type IS NULL AS event_type_was_imputed FROM h""")
def impute_median_mode(t):
    return clean.impute(_holes(t), _hole_stats(t))


@query("""WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END END AS n FROM orders), m AS (SELECT avg(n) FILTER (n IS NOT NULL) AS x FROM (SELECT 1 AS n UNION ALL SELECT 2))
SELECT o_orderkey, coalesce(n::DOUBLE, (SELECT x FROM m)) AS n, n IS NULL AS n_was_imputed FROM h""")
def impute_whole_numbers(t):
    whole = F.when(F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2))
    return clean.impute(t("orders").select("o_orderkey", whole.alias("n")), {"n": {"median": 1.5, "mode": None}})


@query(f"""WITH {_HOLES}, m AS (SELECT quantile_cont(value, 0.5) AS x FROM h), w AS (SELECT event_type AS x FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, coalesce(value, (SELECT x FROM m)) AS value, coalesce(event_type, (SELECT x FROM w)) AS event_type FROM h""")
def impute_fallback(t):
    rows = _holes(t)
    return clean.impute(rows, profile.fallbacks(rows, {"event_id": {"mode": "0"}}, "event_id"), flags=False)


@query(f"""WITH {_HOLES} SELECT event_id, coalesce(value, {_MODE.format(c="value")}::DOUBLE) AS value, CASE WHEN event_type IS NULL OR event_type = '' THEN {_MODE.format(c="event_type")} ELSE event_type END AS event_type FROM h""")
def impute_mode_first(t):
    return clean.impute(_holes(t), _hole_stats(t), ("mode", "median"), flags=False, empty_is_missing=True)


@query(f"""WITH {_HOLES} SELECT event_id, coalesce(value, {_MODE.format(c="value")}::DOUBLE) AS value, regexp_replace(trim(lower(CASE WHEN event_type IS NULL OR event_type = '' THEN {_MODE.format(c="event_type")} ELSE event_type END)), '^[^\\w]+|[^\\w]+$', '', 'g') AS event_type FROM h""")
def row_cleaner(t):
    return clean.clean_rows(_holes(t), _hole_stats(t), skip=("event_id",))


_BOUNDS = "q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"


@query(f"WITH {_BOUNDS} SELECT event_id, NOT (value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS value_is_outlier FROM events, q")
def iqr_outliers(t):
    return clean.outlier_flags(t("events").select("event_id", "value"), ["value"]).select("event_id", "value_is_outlier")


@query(f"WITH {_BOUNDS} SELECT event_id, value FROM events, q WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def drop_outliers(t):
    return clean.drop_outliers(clean.outlier_flags(t("events").select("event_id", "value"), ["value"])).select("event_id", "value")


@query("""WITH v AS (SELECT event_id, event_type AS base, lower(CASE WHEN event_id % 9 = 0 THEN event_type || 's' WHEN event_id % 10 = 0 THEN upper(event_type) ELSE event_type END) AS v FROM events),
f AS (SELECT base, v, row_number() OVER (PARTITION BY base ORDER BY min(event_id)) AS r FROM v GROUP BY base, v) SELECT event_id, f.v AS event_type FROM v JOIN f ON f.base = v.base AND f.r = 1""")
def category_merge(t):
    typo = F.when(F.col("event_id") % 9 == 0, F.concat("event_type", F.lit("s"))).when(F.col("event_id") % 10 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return clean.merge_categories(t("events").select("event_id", F.lower(typo).alias("event_type")), ["event_type"], "event_id")


@query("""SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'promotion' WHEN 'SMALL' THEN 'little' ELSE p_type END AS p_type FROM part""")
def alias_lookup(t):
    return t("part").select("p_partkey", text.canonical(F.col("p_type"), {"PROMO": "promotion", "SMALL": "little"}).alias("p_type"))


# -------------------------------------------------------------- nested, drift


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS "props.k" FROM events""")
def flatten_json_props(t):
    nested = t("events").select("event_id", F.from_json("props", "k long").alias("props"))
    return shape.flatten(nested)


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events""")
def drift_union(t):
    e = t("events")
    return shape.union_drift([e.filter("event_id % 2 = 0").select("event_id", "event_type"), e.filter("event_id % 2 = 1").select("event_id", "value")])


@query("""SELECT n_name, NULL::VARCHAR AS n_comment, n_nationkey FROM nation""")
def schema_align(t):
    return shape.align(t("nation"), ["n_name", "n_comment", "n_nationkey"])


# ------------------------------------------------------------------ lineage

_CLEANED = "o AS (SELECT p_partkey, p_name, p_type, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS p_size FROM part), n AS (SELECT p_partkey, lower(p_name) AS p_name, lower(p_type) AS p_type, coalesce(p_size, 7) AS p_size FROM o)"
_CELLS = f"""WITH {_CLEANED}, j AS (SELECT p_partkey AS row_id, o.p_name AS a1, n.p_name AS b1, o.p_type AS a2, n.p_type AS b2, o.p_size::VARCHAR AS a3, n.p_size::VARCHAR AS b3 FROM o JOIN n USING (p_partkey)),
x AS (SELECT row_id, 'p_name' AS column_name, a1 AS original_value, b1 AS cleaned_value FROM j UNION ALL SELECT row_id, 'p_type', a2, b2 FROM j UNION ALL SELECT row_id, 'p_size', a3, b3 FROM j)"""


def _cleaned(t):
    old = t("part").select("p_partkey", "p_name", "p_type", F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("p_size"))
    return old, old.select("p_partkey", F.lower("p_name").alias("p_name"), F.lower("p_type").alias("p_type"), F.coalesce("p_size", F.lit(7)).alias("p_size"))


@query(_CELLS + " SELECT *, CASE WHEN original_value IS NULL THEN 'imputation' ELSE 'normalization' END AS kind FROM x WHERE original_value IS DISTINCT FROM cleaned_value")
def cell_changes(t):
    return lineage.changes(*_cleaned(t), "p_partkey")


@query(_CELLS + """ SELECT 'job' AS job_id, row_id, column_name, original_value, cleaned_value, 'cleaned' AS transformation_id, CASE WHEN original_value IS NULL THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence_score, 'clean' AS source FROM x WHERE original_value IS DISTINCT FROM cleaned_value""")
def cell_provenance(t):
    return lineage.provenance(*_cleaned(t), "p_partkey")


@query("""WITH d AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS r FROM part)
SELECT 'job' AS job_id, p_partkey AS row_id, '*' AS column_name, 'exact_duplicate' AS transformation_id, 0.0::DOUBLE AS confidence_score, 'clean' AS source FROM d WHERE r > 1""")
def duplicate_provenance(t):
    part = t("part").select("p_partkey", "p_brand", "p_type")
    dropped = dedupe.repeats(part, hashing.content_hash(part.drop("p_partkey")), "p_partkey")
    return lineage.duplicate_records(dropped, "p_partkey").drop("original_value", "cleaned_value")


@query(_CELLS + " SELECT row_id, column_name, 0.9::DOUBLE AS confidence_score FROM x WHERE original_value IS NULL AND cleaned_value IS NOT NULL")
def review_filter(t):
    return lineage.needs_review(lineage.provenance(*_cleaned(t), "p_partkey"), 0.5, 0.95).select("row_id", "column_name", "confidence_score")


@query("""SELECT event_id AS row_id, round(CASE WHEN event_id % 21 = 0 THEN 0.0 ELSE greatest(0.5, (CASE WHEN event_id % 7 = 0 THEN 0.9 ELSE 1.0 END) * (CASE WHEN event_id % 5 = 0 THEN 0.85 ELSE 1.0 END)) END, 6)::DOUBLE AS confidence FROM events""")
def confidence(t):
    i = F.col("event_id")
    return t("events").select(i.alias("row_id"), F.round(quality.confidence(i % 7 == 0, i % 5 == 0, i % 21 == 0), 6).alias("confidence"))


@query("""SELECT event_id, event_type FROM events WHERE event_type = 'click'""")
def audit_filter(t):
    return lineage.audit_filter(t("events").withColumnRenamed("event_type", "action"), "click").select("event_id", F.col("action").alias("event_type"))


@query(f"""WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY md5({_NORMAL}) ORDER BY doc_id) AS r FROM documents)
SELECT count(*) AS rows_total, count(*) FILTER (r = 1) AS rows_kept, count(*) FILTER (r > 1) AS rows_dropped, count(*) FILTER (doc_id % 3 = 0) AS imputations, count(*) FILTER (doc_id % 3 = 1) AS normalizations, round(count(*) FILTER (r = 1) / count(*), 9) AS deduplication_rate, 1.0::DOUBLE AS mean_confidence FROM h""")
def worker_stats(t):
    docs = t("documents").withColumn("h", hashing.joined_hash([_normal(F.col("text"))])).drop("text")
    kinds = docs.select(F.when(F.col("doc_id") % 3 == 0, "imputation").when(F.col("doc_id") % 3 == 1, "normalization").alias("kind"))
    out = lineage.worker_stats(docs, dedupe.keep_first(docs, F.col("h"), "doc_id"), kinds, docs.select(F.lit(1.0).alias("confidence")))
    return out.withColumn("deduplication_rate", F.round("deduplication_rate", 9))


# ---------------------------------------------------------- whole pipelines

#: Events with holes, plural and padded upper-case types, and rows that repeat.
_DIRTY = """h AS (SELECT event_id AS row_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 9 = 0 THEN event_type || 's' WHEN event_id % 10 = 0 THEN ' ' || upper(event_type) || ' ' ELSE event_type END AS event_type,
 CASE WHEN event_id % 7 <> 0 THEN round(value) END AS value, (user_id % 4)::DOUBLE AS bucket FROM events),
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY event_type, value, bucket ORDER BY row_id) = 1)"""


def _dirty(t):
    i, kind = F.col("event_id"), F.col("event_type")
    spelt = F.when(i % 9 == 0, F.concat(kind, F.lit("s"))).when(i % 10 == 0, F.concat(F.lit(" "), F.upper(kind), F.lit(" "))).otherwise(kind)
    return t("events").select(i.alias("row_id"), F.when(i % 11 != 0, spelt).alias("event_type"), F.when(i % 7 != 0, F.round("value")).alias("value"), (F.col("user_id") % 4).cast("double").alias("bucket"))


_IQR = "coalesce({c} NOT BETWEEN q.{c}1 - 1.5 * (q.{c}3 - q.{c}1) AND q.{c}3 + 1.5 * (q.{c}3 - q.{c}1) AND q.{c}3 > q.{c}1, false)"


@query(f"""WITH {_DIRTY}, m AS (SELECT quantile_cont(value, 0.5) AS value FROM h WHERE row_id % 10 = 0),
w AS (SELECT lower(trim(event_type)) AS mode FROM h WHERE row_id % 20 = 0 AND event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(row_id) LIMIT 1),
f AS (SELECT row_id, lower(trim(coalesce(event_type, w.mode))) AS v, coalesce(k.value, m.value) AS value, bucket, event_type IS NULL AS event_type_was_imputed, k.value IS NULL AS value_was_imputed FROM k, m, w),
q AS (SELECT quantile_cont(value, 0.25) AS value1, quantile_cont(value, 0.75) AS value3, quantile_cont(bucket, 0.25) AS bucket1, quantile_cont(bucket, 0.75) AS bucket3 FROM f),
b AS (SELECT *, CASE WHEN v IN (SELECT event_type FROM events) THEN v ELSE v[1:len(v) - 1] END AS base FROM f), l AS (SELECT base, arg_min(v, row_id) AS leader FROM b GROUP BY 1)
SELECT row_id, leader AS event_type, value, bucket, event_type_was_imputed, value_was_imputed, false AS bucket_was_imputed, {_IQR.format(c="value")} AS value_is_outlier, {_IQR.format(c="bucket")} AS bucket_is_outlier FROM b JOIN l USING (base), q""")
def clean_table_events(t):
    """The full pipeline: statistics, exact duplicates, imputation, outliers, texts, categories."""
    return pipeline.clean_table(_dirty(t), near_threshold=None).cleaned


_WORKED = f"""{_DIRTY}, n AS (SELECT (SELECT value::VARCHAR AS v FROM h WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)::DOUBLE AS value, (SELECT event_type AS v FROM h WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1) AS mode),
g AS (SELECT row_id, k.event_type AS a, lower(trim(coalesce(k.event_type, n.mode))) AS event_type, k.value AS b, coalesce(k.value, n.value) AS value, bucket FROM k, n)"""


@query(f"WITH {_WORKED} SELECT row_id, event_type, value, bucket FROM g")
def clean_worker_events(t):
    """The row-wise pipeline: each row cleaned by itself with the statistics of the first pass."""
    return pipeline.clean_worker(_dirty(t)).cleaned


@query(f"""WITH {_WORKED} SELECT row_id, 'event_type' AS column_name, a AS original_value, event_type AS cleaned_value, 'cleaned' AS transformation_id, CASE WHEN a IS NULL THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence_score FROM g WHERE a IS DISTINCT FROM event_type
UNION ALL SELECT row_id, 'value', NULL, value::VARCHAR, 'cleaned', 0.9::DOUBLE FROM g WHERE b IS NULL
UNION ALL SELECT row_id, '*', NULL, NULL, 'exact_duplicate', 0.0::DOUBLE FROM h WHERE row_id NOT IN (SELECT row_id FROM k)""")
def clean_worker_provenance(t):
    """A record for each cell that the row-wise pipeline changes and for each row that goes as a duplicate."""
    return pipeline.clean_worker(_dirty(t)).provenance.drop("job_id", "source")


@query(f"WITH {_WORKED} SELECT row_id, CASE WHEN a IS NULL OR b IS NULL THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM g")
def clean_worker_confidence(t):
    return pipeline.clean_worker(_dirty(t)).scores


# ------------------------------------------------------- reports, enrichment


@query(f"""WITH {_HOLES}, {_BOUNDS} SELECT (SELECT count(*) FROM h) AS original_row_count, count(*) AS cleaned_row_count, (SELECT count(*) FROM h) - count(*) AS rows_dropped_total, 0::BIGINT AS near_duplicates_flagged,
count(*) FILTER (h.value IS NULL)::BIGINT AS value_was_imputed, count(*) FILTER (h.event_type IS NULL)::BIGINT AS event_type_was_imputed FROM h WHERE event_id % 3 <> 0""")
def clean_report(t):
    rows = _holes(t)
    return report.summary(rows, clean.impute(rows.filter("event_id % 3 <> 0"), _hole_stats(t)))


@query("""WITH c AS (SELECT p_name AS a, lower(p_name) AS b, 1 AS w FROM part UNION ALL SELECT p_type, lower(p_type), 1 FROM part UNION ALL SELECT p_size::VARCHAR, p_size::VARCHAR, 0 FROM part)
SELECT count(*) AS total_cells, count(*) FILTER (a <> b) AS changed_cells, round(avg(1 - levenshtein(a, b) / greatest(len(a), len(b), 1)) FILTER (w = 1), 6) AS mean_text_similarity, round(100 * count(*) FILTER (a <> b) / count(*), 6) AS percent_changed FROM c""")
def normalization_accuracy(t):
    old = t("part").select("p_partkey", "p_name", "p_type", "p_size")
    new = old.select("p_partkey", F.lower("p_name").alias("p_name"), F.lower("p_type").alias("p_type"), "p_size")
    out = report.normalization_accuracy(old, new, "p_partkey", ["p_name", "p_type", "p_size"], "levenshtein")
    return out.withColumns({"mean_text_similarity": F.round("mean_text_similarity", 6), "percent_changed": F.round("percent_changed", 6)})


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS row_id, 0 AS candidate_id, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE upper(p_name[1:6]) || p_name[7:] END AS b FROM part), {_RATIO}
SELECT count(*) AS total_cells, count(*) FILTER (a <> b) AS changed_cells, round(avg(ratio), 6) AS mean_text_similarity, round(100 * count(*) FILTER (a <> b) / count(*), 6) AS percent_changed FROM q JOIN p USING (row_id)""")
def normalization_accuracy_ratio(t):
    """The accuracy by the matching-blocks ratio, which is the default."""
    old = t("part").select("p_partkey", "p_name", "p_brand")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.concat(F.upper(F.substring("p_name", 1, 6)), F.expr("substring(p_name, 7)")))
    out = report.normalization_accuracy(old, old.withColumn("p_name", name), "p_partkey", ["p_name"])
    return out.withColumns({"mean_text_similarity": F.round("mean_text_similarity", 6), "percent_changed": F.round("percent_changed", 6)})


@query(r"""SELECT event_id, len(regexp_extract_all(event_type, '\S+')) AS event_type__token_count, (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS event_type__suggested_canonical FROM events""")
def token_count_canonical(t):
    return enrich.enrich(t("events").select("event_id", "event_type"), ["event_type"]).drop("event_type")


# ------------------------------------------------------------------ privacy

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g'), '\b\d{{3}}-\d{{2}}-\d{{4}}\b', '<SSN>', 'g'), '\b\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}\b', '<CARD>', 'g'), '\+\d{{1,3}} \(\d{{3}}\) \d{{3}}-\d{{4}}', '<PHONE>', 'g')) AS redacted_md5 FROM documents""")
def pii_redact(t):
    return t("documents").select("doc_id", F.md5(privacy.redact(F.col("text"))).alias("redacted_md5"))


@query("""SELECT c_custkey, sha256('s3' || c_name) AS c_name FROM customer""")
def pii_hash(t):
    return privacy.protect(t("customer").select("c_custkey", "c_name"), {"c_name": "hash"}, "s3")


_TOKEN = "'tok_' || sha256('s3' || {c})[1:32]"


@query(f"""SELECT c_custkey, {_TOKEN.format(c="c_name")} AS c_name FROM customer""")
def pii_tokenize(t):
    return privacy.protect(t("customer").select("c_custkey", "c_name"), {"c_name": "tokenize"}, "s3")


@query(f"""SELECT DISTINCT {_TOKEN.format(c="c_mktsegment || c_nationkey")} AS token, c_mktsegment || c_nationkey AS value FROM customer""")
def pii_token_vault(t):
    """Two jobs that share values; each value lies in the vault once."""
    vault = privacy.TokenVault(t.spark, f"{scratch(t.spark)}/vault", "s3")
    rows = t("customer").select("c_custkey", F.concat("c_mktsegment", "c_nationkey").alias("who"))
    for job in (rows.filter("c_custkey % 3 < 2"), rows.filter("c_custkey % 3 > 0")):
        privacy.protect(job, {"who": "tokenize"}, vault=vault)
    return vault.read()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS who FROM orders""")
def pii_reveal(t):
    """Tokens told again by the vault; five values stand for all rows, and what is no token stays unknown."""
    vault = privacy.TokenVault(t.spark, f"{scratch(t.spark)}/vault", "s3")
    rows = privacy.protect(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("who")), {"who": "tokenize"}, vault=vault)
    return vault.reveal(rows.withColumn("who", F.when(F.col("o_orderkey") % 7 != 0, F.col("who")).otherwise("tok_none")), "who")


@query("""SELECT c_custkey, c_mktsegment FROM customer""")
def pii_exclude(t):
    return privacy.protect(t("customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "exclude"})


# --------------------------------------------------------- rates, rules, jobs


@query("""SELECT user_id AS tenant, time_bucket(INTERVAL '60 seconds', ts) AS window_start, count(*) AS calls, count(*) > 100 AS over_limit FROM events GROUP BY 1, 2""")
def rate_limit_window(t):
    from millrace.streaming.rates import calls_per_window

    return calls_per_window(t("events").select(F.col("user_id").alias("tenant"), "ts"))


@query("""SELECT 'non_negative' AS rule, 'c_acctbal' AS "column", count(*) FILTER (c_acctbal < 0) AS violations FROM customer
UNION ALL SELECT 'one_of', 'c_mktsegment', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer
UNION ALL SELECT 'unique', 'c_nationkey', (count(*) - count(DISTINCT c_nationkey))::BIGINT FROM customer""")
def business_rules(t):
    return constraints.violations(t("customer"), [("non_negative", "c_acctbal"), ("one_of", "c_mktsegment", ["BUILDING", "MACHINERY"]), ("unique", "c_nationkey")])


@query("""WITH b AS (SELECT avg(c_acctbal) AS x, avg(c_nationkey) AS y FROM customer), a AS (SELECT avg(c_acctbal * 2) AS x, avg(c_nationkey) AS y FROM customer WHERE c_custkey % 2 = 0)
SELECT 'c_acctbal' AS "column", round(b.x, 6) AS mean_before, round(a.x, 6) AS mean_after, abs(a.x - b.x) > 0.1 * abs(b.x) AS drifted FROM a, b
UNION ALL SELECT 'c_nationkey', round(b.y, 6), round(a.y, 6), abs(a.y - b.y) > 0.1 * abs(b.y) FROM a, b""")
def drift(t):
    c = t("customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = constraints.drift(c, c.filter("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), ["c_acctbal", "c_nationkey"])
    return out.select("column", F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"), "drifted")


@query("""SELECT o_orderstatus AS status, count(*) AS jobs FROM orders GROUP BY 1""")
def job_metrics(t):
    from millrace.plans.jobs import metrics

    return metrics(t("orders").withColumnRenamed("o_orderstatus", "status"))


@query("""SELECT q.vec_id AS query_id, v.vec_id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), v.vec_id)::INT AS rank
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10""")
def ann_exact_topk_l2(t):
    v = t("embeddings")
    return vectors.nearest(v, v.filter("vec_id % 100 = 0")).withColumn("distance", F.round("distance", 6))


#: Every 25th vector is a centre; vectors lie in the list of the nearest, and queries look into the lists of the 14 nearest.
_LISTS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT vec_id AS list, v AS centre FROM e WHERE vec_id % 25 = 0),
l AS (SELECT vec_id, v, list, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, centre), list) AS place FROM e, c),
a AS (SELECT q.vec_id AS query_id, s.vec_id, list_distance(q.v, s.v) AS distance FROM l q JOIN l s ON q.list = s.list AND s.place = 1 AND q.vec_id <> s.vec_id WHERE q.vec_id % 100 = 0 AND q.place <= 14)"""


def _index(t):
    """Vectors stored as two jobs, the even ids first."""
    v = t("embeddings")
    centres = v.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("list"), F.col("embedding").alias("centre"))
    index = vectors.VectorIndex.create(v, scratch(t.spark), looks=14, centres=centres)
    for job, half in (("even", 0), ("odd", 1)):
        index.append(v.filter(F.col("vec_id") % 2 == half), job)
    return vectors.VectorIndex(t.spark, index.path), v.filter("vec_id % 100 = 0")


@query(f"""WITH {_LISTS} SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM a QUALIFY rank <= 10""")
def ann_stored_index(t):
    index, asked = _index(t)
    return index.search(asked).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_LISTS} SELECT query_id, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM a WHERE vec_id % 2 = 1 QUALIFY rank <= 5""")
def ann_stored_index_of_a_job(t):
    index, asked = _index(t)
    return index.search(asked, 5, "odd").withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_LISTS}, f AS (SELECT query_id, vec_id FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10),
x AS (SELECT q.vec_id AS query_id, s.vec_id FROM e q JOIN e s ON q.vec_id <> s.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, s.v), s.vec_id) <= 10)
SELECT query_id, x.vec_id, f.vec_id IS NOT NULL AS found FROM x LEFT JOIN f USING (query_id, vec_id)""")
def ann_stored_index_recall(t):
    """The exact neighbours, and whether the stored index finds each."""
    index, asked = _index(t)
    found = index.search(asked).select("query_id", "vec_id", F.lit(True).alias("found"))
    return vectors.nearest(t("embeddings"), asked).select("query_id", "vec_id").join(found, ["query_id", "vec_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query("""SELECT n_regionkey, max(n_nationkey) AS last FROM nation GROUP BY 1 UNION SELECT r_regionkey, r_regionkey FROM region""")
def union_distinct(t):
    return t("nation").groupBy("n_regionkey").agg(F.max("n_nationkey").alias("last")).union(t("region").select("r_regionkey", "r_regionkey")).distinct()


@query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def set_intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("""SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0""")
def set_difference(t):
    return t("orders").select(F.col("o_custkey").alias("k")).subtract(t("customer").filter("c_custkey % 3 = 0").select("c_custkey"))


@query("""SELECT (count(*) FILTER (vec_id % 100 = 0))::BIGINT AS queries, true AS recall_reached FROM embeddings""")
def ann_approximate_recall(t):
    """How the approximate search compares with the exact one over the stated queries."""
    v = t("embeddings")
    asked = v.filter("vec_id % 100 = 0")
    exact = vectors.nearest(v, asked).select("query_id", "vec_id")
    found = vectors.nearest_approximate(v, asked).select("query_id", "vec_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


@query(f"""WITH RECURSIVE p AS (SELECT x.p_partkey AS row_id, y.p_partkey AS candidate_id, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1), {_RATIO}
SELECT row_id, candidate_id, round(ratio, 9) AS ratio FROM q""")
def matching_blocks_ratio(t):
    """The ratio of each name to the next one's."""
    part = t("part").select("p_partkey", "p_name")
    pairs = part.join(part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next")), "p_partkey")
    return pairs.select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") + 1).alias("candidate_id"), F.round(dedupe.ratio(F.col("p_name"), F.col("next")), 9).alias("ratio"))


@query("SELECT event_id, upper(event_type) AS event_type FROM events")
def model_hook(t):
    def shout(frames):
        for f in frames:
            yield f.assign(event_type=f["event_type"].str.upper())

    return enrich.analyse(t("events").select("event_id", "event_type"), shout)


@query(f"""WITH {_CUSTOMER}, {_SHINGLES}, {_SIGNATURES}, {_BUCKETS} SELECT DISTINCT bucket_key, b.c_custkey AS sampled_row_id, s AS snippet FROM b JOIN c USING (c_custkey) WHERE b.c_custkey % 50 = 0""")
def lsh_sample_insert(t):
    """Samples appended twice lie in the store once."""
    from millrace.plans.jobs import JobStore

    store, rows = JobStore(t.spark, scratch(t.spark)), _customers(t)
    for every in (100, 50):
        store.add_samples("j", dedupe.lsh_samples(rows, F.col("snippet"), "c_custkey", every))
    return store.read("lsh_samples").drop("job_id")
