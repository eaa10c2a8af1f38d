"""One query per operator over the driver's tables, and the SQL that says what it gives.

documents are snippets (doc_id names them, source is their collection, lang their tag), conversations are version histories, and
part gives small assembly listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cfg, edit, text
from ..functions.signature import pack_udf, unpack_udf
from ..operators import search, store
from ..operators.once import once
from ..params import PRIME, SearchParams, permutations
from ..sources import export

WORD = SearchParams(tokenizer="word")
ASM = SearchParams(tokenizer="asm")
LOOSE = SearchParams(tokenizer="word", threshold=0.2)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def incoming(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return table(spark, d, "documents").where(where).select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("code"), F.col("lang").alias("tag"), F.col("source").alias("collection"))


def built(spark: SparkSession, d: str, where: str = "true", signed: bool = True) -> DataFrame:
    """The store of documents. Without signatures where a query doesn't need them: the plan is then a scan and one aggregation."""
    if signed:
        return store.add_batch(store.empty(spark), incoming(spark, d, where), WORD)
    return store.group_prepared(store.prepare(incoming(spark, d, where), WORD)).withColumn("sig", F.lit(None).cast("array<bigint>")).select("checksum", "names", "code", "sig", "tags", "collection")


def signatures(spark: SparkSession, d: str) -> DataFrame:
    """(checksum, sig) of the store, kept where a query reads it several times."""
    return once(built(spark, d).select("checksum", "sig"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """Assembly of each part."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("cpuid", "nop", "rdtsc", "imul ecx, edx"))), (k % 4 + 1).cast("int"))
    m = lambda n: (k % n).cast("string")
    code = F.concat(F.lit("f_"), k.cast("string"), F.lit(":\n  mov eax, "), s, F.lit(" ; "), F.col("p_brand"), F.lit("\n  cmp dword [ebp+"), s, F.lit("H], ebx\n  jz done_"), m(7), F.lit("\n  "), kind, F.lit("\n  call f_"), m(13), F.lit("\ndone_"), m(7), F.lit(":\n  ret"))
    return table(spark, d, "part").select(k.alias("ord"), k.cast("string").alias("name"), code.alias("code"))


_A, _B = permutations(128)
_CANON = r"trim(regexp_replace({c}, '[ \t\r\n\f]+', ' ', 'g'))"
_STORE = f"""docs AS (SELECT *, sha256(c) AS checksum FROM (SELECT *, {_CANON.format(c="text")} AS c FROM documents WHERE {{where}}) WHERE length(c) > 0),
store AS (SELECT checksum, arg_min(text, doc_id) AS code, list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) AS names, list_sort(list(DISTINCT lang)) AS tags, arg_min(source, doc_id) AS collection FROM docs GROUP BY checksum)"""
STORE = _STORE.format(where="true")
_SHINGLES = """sh AS (SELECT checksum, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s
  FROM (SELECT checksum, regexp_extract_all(lower(code), '([a-z0-9]+)', 1) AS t FROM {src}))"""
_SIGNATURE = f"""perm AS (SELECT unnest(range(128)) AS k, unnest({list(_A)}::BIGINT[]) AS a, unnest({list(_B)}::BIGINT[]) AS b),
eh AS (SELECT checksum, ('0x' || substr(md5(x), 1, 8))::BIGINT % {PRIME} AS x FROM (SELECT checksum, unnest(s) AS x FROM sh)),
sg AS (SELECT checksum, k, min((a * x + b) % {PRIME}) AS v FROM eh, perm GROUP BY ALL)"""
SIGNED = f"WITH {STORE}, {_SHINGLES.format(src='store')}, {_SIGNATURE}"
_BANDS = "bands AS (SELECT checksum, k // {r} AS band, string_agg(CAST(v AS VARCHAR), '-' ORDER BY k) AS bucket FROM sg WHERE k < {b} * {r} GROUP BY ALL)"
_PAIRS = """pairs AS (SELECT DISTINCT x.checksum AS l, y.checksum AS r FROM bands x JOIN bands y ON x.band = y.band AND x.bucket = y.bucket AND x.checksum < y.checksum),
sim AS (SELECT l, r, count(*) FILTER (WHERE a.v = b.v) / 128.0::DOUBLE AS j FROM pairs JOIN sg a ON a.checksum = l JOIN sg b ON b.checksum = r AND a.k = b.k GROUP BY ALL)"""
B, R = WORD.bands
_LISTING = """'f_' || p_partkey || ':' || chr(10) || '  mov eax, ' || p_size || ' ; ' || p_brand || chr(10) || '  cmp dword [ebp+' || p_size || 'H], ebx' || chr(10) || '  jz done_' || p_partkey % 7 || chr(10) || '  '
 || ['cpuid', 'nop', 'rdtsc', 'imul ecx, edx'][p_partkey % 4 + 1] || chr(10) || '  call f_' || p_partkey % 13 || chr(10) || 'done_' || p_partkey % 7 || ':' || chr(10) || '  ret'"""
_RAW = "list_filter(regexp_extract_all({c}, '(" + text.ASM.replace("'", "''") + ")', 1), lambda t: NOT regexp_matches(t, '^[;%]'))"
_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_ASM_TOKENS = f"""list_transform({_RAW.format(c="code")}, lambda t: CASE WHEN lower(t) IN {_IN(text.REGISTERS)} THEN 'REG' WHEN regexp_matches(t, '{text.NUMBER}') THEN 'IMM'
  WHEN t LIKE '%:' THEN 'LABEL' WHEN lower(t) IN {_IN(text.SIZES)} THEN 'MEM_SIZE' ELSE upper(t) END)"""
LISTINGS = f"WITH listing AS (SELECT p_partkey AS ord, {_LISTING} AS code FROM part)"


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def table_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query(f"SELECT doc_id, sha256({_CANON.format(c='text')}) AS checksum FROM documents WHERE length({_CANON.format(c='text')}) > 0")
def prepare_checksums(spark, d):
    return store.prepare(incoming(spark, d), WORD).select(F.col("ord").alias("doc_id"), "checksum")


@query(f"{LISTINGS} SELECT ord, sha256(trim(regexp_replace(regexp_replace(code, ';[^\\n]*', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g'))) AS checksum FROM listing")
def prepare_assembly(spark, d):
    return store.prepare(listings(spark, d), ASM).select("ord", "checksum")


@query(f"WITH {STORE} SELECT checksum, array_to_string(names, ',') AS names, array_to_string(tags, ',') AS tags, collection, CAST(length(code) AS INTEGER) AS n FROM store")
def import_batch(spark, d):
    s = built(spark, d, signed=False)
    return s.select("checksum", F.array_join("names", ",").alias("names"), F.array_join("tags", ",").alias("tags"), "collection", F.length("code").alias("n"))


@query(f"""WITH {_STORE.format(where="doc_id % 3 <> 0")}, inc AS (SELECT sha256({_CANON.format(c="text")}) AS checksum, count(*) AS n FROM documents WHERE doc_id % 3 <> 1 AND length({_CANON.format(c="text")}) > 0 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_input, count(*) FILTER (WHERE s.checksum IS NULL) AS n_added, count(*) FILTER (WHERE s.checksum IS NOT NULL) AS n_aliased, CAST(sum(n - 1) AS BIGINT) AS n_skipped FROM inc LEFT JOIN store s USING (checksum)""")
def import_counts(spark, d):
    return store.add_counts(built(spark, d, "doc_id % 3 <> 0", signed=False), incoming(spark, d, "doc_id % 3 <> 1"), WORD)


@query("SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents)")
def word_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"{LISTINGS} SELECT ord, array_to_string({_ASM_TOKENS}, ' ') AS tokens FROM listing")
def assembly_tokens(spark, d):
    return listings(spark, d).select("ord", F.array_join(text.asm_tokens(F.col("code")), " ").alias("tokens"))


@query(f"""{LISTINGS}, t AS (SELECT ord, {_ASM_TOKENS} AS t FROM listing), s AS (SELECT ord, unnest(list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' ')))) AS s FROM t),
w AS (SELECT ord, s, CASE WHEN list_has_any(string_split(s, ' '), {list(text.RARE)}) THEN 3 WHEN len(list_filter(string_split(s, ' '), lambda x: x NOT IN {_IN(text.COMMON)})) = 0 THEN 1 ELSE 2 END AS w FROM s)
SELECT s AS shingle, CAST(w AS INTEGER) AS weight, count(*) AS n FROM w GROUP BY ALL""")
def shingle_weights(spark, d):
    s = listings(spark, d).select(F.explode(text.shingles(text.asm_tokens(F.col("code")), 3)).alias("shingle"))
    return s.groupBy("shingle").agg(F.count("*").alias("n")).select("shingle", text.shingle_weight(F.col("shingle")).alias("weight"), "n")


@query(f"WITH {STORE}, {_SHINGLES.format(src='store')} SELECT checksum, CAST(len(s) AS INTEGER) AS n_shingles FROM sh")
def shingle_sets(spark, d):
    s = built(spark, d, signed=False)
    return s.select("checksum", F.size(text.shingles(text.word_tokens(F.col("code")), 3)).alias("n_shingles"))


@query(f"{SIGNED} SELECT checksum, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS digest FROM sg GROUP BY checksum")
def minhash_signatures(spark, d):
    s = built(spark, d).where(search.has_elements(F.col("sig")))
    return s.select("checksum", F.md5(F.array_join("sig", ",").cast("binary")).alias("digest"))


@query(f"{SIGNED} SELECT checksum, max(v) AS hi, min(v) AS lo, CAST(sum(v) AS BIGINT) AS total FROM sg GROUP BY checksum")
def packed_signatures(spark, d):
    s = built(spark, d).where(search.has_elements(F.col("sig"))).withColumn("sig", unpack_udf(pack_udf("sig")))
    return s.select("checksum", F.array_max("sig").alias("hi"), F.array_min("sig").alias("lo"), F.aggregate("sig", F.lit(0).cast("bigint"), lambda n, x: n + x).alias("total"))


@query(f"{SIGNED}, {_BANDS.format(b=B, r=R)} SELECT CAST(band AS INTEGER) AS band, count(*) AS n, count(DISTINCT bucket) AS n_buckets, min(bucket) AS first FROM bands GROUP BY 1")
def band_index(spark, d):
    return search.band_index(built(spark, d), WORD).groupBy("band").agg(F.count("*").alias("n"), F.countDistinct("bucket").alias("n_buckets"), F.min("bucket").alias("first"))


@query(f"{SIGNED}, {_BANDS.format(b=B, r=R)}, {_PAIRS} SELECT l AS left, r AS right, j AS jaccard FROM sim WHERE j >= 0.5")
def similar_pairs(spark, d):
    return search.similar_pairs(built(spark, d), WORD)


@query(f"""{SIGNED}, {_BANDS.format(b=B, r=R)}, {_PAIRS}, sides AS (SELECT l, r, j FROM sim WHERE j >= 0.5 UNION ALL SELECT r, l, j FROM sim WHERE j >= 0.5)
SELECT l AS checksum, CAST(rank AS INTEGER) AS rank, r AS neighbour, j AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY j DESC, r) AS rank FROM sides) WHERE rank <= 5""")
def near_duplicate_top5(spark, d):
    return search.nearest(built(spark, d), WORD)


def _questions(spark, d):
    """Every seventh document, in lower case and without its first words, is a query."""
    docs = table(spark, d, "documents").where("doc_id % 7 = 0").select(F.col("doc_id").alias("query_id"), F.expr("substring(text, 20)").alias("code")).where("length(code) > 0")
    return search.fingerprint(docs, WORD)


_QUESTIONS = f"""q AS (SELECT doc_id AS query_id, substr(text, 20) AS code FROM documents WHERE doc_id % 7 = 0 AND length(substr(text, 20)) > 0),
qsh AS (SELECT query_id, CASE WHEN len(t) >= 3 THEN list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS s FROM (SELECT query_id, regexp_extract_all(lower(code), '([a-z0-9]+)', 1) AS t FROM q)),
qeh AS (SELECT query_id, ('0x' || substr(md5(x), 1, 8))::BIGINT % {PRIME} AS x FROM (SELECT query_id, unnest(s) AS x FROM qsh)),
qsg AS (SELECT query_id, k, min((a * x + b) % {PRIME}) AS v FROM qeh, perm GROUP BY ALL),
qbands AS (SELECT query_id, k // {{r}} AS band, string_agg(CAST(v AS VARCHAR), '-' ORDER BY k) AS bucket FROM qsg WHERE k < {{b}} * {{r}} GROUP BY ALL),
cand AS (SELECT DISTINCT query_id, checksum FROM qbands JOIN bands USING (band, bucket))"""


@query(f"{SIGNED}, {_BANDS.format(b=B, r=R)}, {_QUESTIONS.format(b=B, r=R)} SELECT q.query_id, count(checksum) AS n_candidates FROM q LEFT JOIN cand USING (query_id) GROUP BY 1")
def candidate_counts(spark, d):
    return search.candidate_counts(_questions(spark, d), built(spark, d), WORD)


@query(f"""{SIGNED}, {_BANDS.format(b=B, r=R)}, {_QUESTIONS.format(b=B, r=R)}, sc AS (SELECT c.query_id, c.checksum, count(*) FILTER (WHERE x.v = y.v) / 128.0::DOUBLE AS j FROM cand c JOIN qsg x ON x.query_id = c.query_id JOIN sg y ON y.checksum = c.checksum AND x.k = y.k GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, checksum, array_to_string(names, ',') AS names, j AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, checksum) AS rank FROM sc) JOIN store USING (checksum) WHERE rank <= 5""")
def find_by_jaccard(spark, d):
    s, q = built(spark, d), _questions(spark, d)
    best = search._rank(search.scored_candidates(q, s, WORD), F.col("jaccard"), WORD.top_n)
    return best.join(s.select("checksum", F.array_join("names", ",").alias("names")), "checksum").select("query_id", "rank", "checksum", "names", "jaccard")


@query()
def find_batch(spark, d):
    return search.find(_questions(spark, d), built(spark, d), WORD).select("query_id", "rank", "checksum", F.round("jaccard", 6).alias("jaccard"), F.round("edit_ratio", 6).alias("edit_ratio"), F.round("score", 6).alias("score"))


@query()
def find_benchmark(spark, d):
    q = search.fingerprint(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("code")), LOOSE)
    return search.find(q, built(spark, d), LOOSE).select("query_id", "rank", "checksum", F.round("jaccard", 6).alias("jaccard"), F.round("score", 6).alias("score"))


NAMES = SearchParams(tokenizer="word", ngram=1)
_LCS = """r AS (SELECT k, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT) AS row FROM {pairs}
  UNION ALL SELECT k, x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda m: greatest(row[m], CASE WHEN m > 1 AND y[m - 1] = x[i + 1] THEN row[m - 1] + 1 ELSE 0 END)))) FROM r WHERE i < length(x)),
ratio AS (SELECT k, 200.0::DOUBLE * row[-1] / (length(x) + length(y)) AS e FROM r WHERE i = length(x))"""


@query(f"""WITH RECURSIVE st AS (SELECT DISTINCT sha256(x) AS id, x AS code FROM (SELECT p_name || ' ' || p_type || ' ' || p_brand AS x FROM part WHERE p_partkey % 3 = 0)),
q AS (SELECT 'q' || p_partkey AS id, p_name || ' ' || p_brand AS code FROM part WHERE p_partkey % 40 = 1), both_sides AS (SELECT * FROM st UNION ALL SELECT * FROM q),
perm AS (SELECT unnest(range(128)) AS k, unnest({list(_A)}::BIGINT[]) AS a, unnest({list(_B)}::BIGINT[]) AS b),
eh AS (SELECT id, ('0x' || substr(md5(x), 1, 8))::BIGINT % {PRIME} AS x FROM (SELECT id, unnest(list_distinct(regexp_extract_all(lower(code), '([a-z0-9]+)', 1))) AS x FROM both_sides)),
sg AS (SELECT id, k, min((a * x + b) % {PRIME}) AS v FROM eh, perm GROUP BY ALL),
bands AS (SELECT id, k // {NAMES.bands[1]} AS band, string_agg(CAST(v AS VARCHAR), '-' ORDER BY k) AS bucket FROM sg WHERE k < {NAMES.bands[0]} * {NAMES.bands[1]} GROUP BY ALL),
cand AS (SELECT DISTINCT x.id AS query, y.id AS checksum FROM bands x JOIN bands y USING (band, bucket) WHERE x.id LIKE 'q%' AND y.id NOT LIKE 'q%'),
sim AS (SELECT query, checksum, count(*) FILTER (WHERE x.v = y.v) / 128.0::DOUBLE AS j FROM cand JOIN sg x ON x.id = query JOIN sg y ON y.id = checksum AND x.k = y.k GROUP BY ALL),
pair AS (SELECT query || '/' || checksum AS k, q.code AS x, st.code AS y FROM cand JOIN q ON q.id = query JOIN st ON st.id = checksum), {_LCS.format(pairs="pair")},
scored AS (SELECT query, checksum, j, e, j * 100.0::DOUBLE * {NAMES.jaccard_weight} + e * {1 - NAMES.jaccard_weight}::DOUBLE AS score FROM sim JOIN ratio ON k = query || '/' || checksum)
SELECT CAST(substr(query, 2) AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, checksum, round(j, 6) AS jaccard, round(e, 6) AS edit_ratio, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, checksum) AS rank FROM scored) WHERE rank <= {NAMES.top_n}""")
def find_names(spark, d):
    """The hybrid ranking on short texts, whose edit ratios SQL can tell."""
    part = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("code"), F.concat_ws(" ", "p_name", "p_brand").alias("question"))
    own = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("name"), "code")
    asked = search.fingerprint(part.where("p_partkey % 40 = 1").select(F.col("p_partkey").alias("query_id"), F.col("question").alias("code")), NAMES)
    return search.find(asked, store.add_batch(store.empty(spark), own, NAMES), NAMES).select("query_id", "rank", "checksum", *(F.round(x, 6).alias(x) for x in ("jaccard", "edit_ratio", "score")))


@query(f"{SIGNED} SELECT checksum, array_to_string(list_sort(names), ',') AS names, CAST(v AS BIGINT) AS total FROM store LEFT JOIN (SELECT checksum, sum(v) AS v FROM sg GROUP BY 1) USING (checksum)")
def add_to_store(spark, d):
    """A batch that comes to a store: known snippets get its names, new ones a signature."""
    s = store.add_batch(built(spark, d, "doc_id % 3 > 0"), incoming(spark, d, "doc_id % 3 = 0"), WORD)
    total = F.when(search.has_elements(F.col("sig")), F.aggregate("sig", F.lit(0).cast("bigint"), lambda a, x: a + x))
    return s.select("checksum", F.array_join(F.array_sort("names"), ",").alias("names"), total.alias("total"))


@query(f"""{LISTINGS}, t AS (SELECT ord, {_ASM_TOKENS} AS t FROM listing), s AS (SELECT ord, unnest(list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i+2], ' ')))) AS s FROM t),
w AS (SELECT ord, s, CASE WHEN list_has_any(string_split(s, ' '), {list(text.RARE)}) THEN 3 WHEN len(list_filter(string_split(s, ' '), lambda x: x NOT IN {_IN(text.COMMON)})) = 0 THEN 1 ELSE 2 END AS w FROM s),
el AS (SELECT ord, CASE WHEN w = 1 THEN s ELSE s || '|' || n END AS x FROM (SELECT ord, s, w, unnest(range(w)) AS n FROM w)),
perm AS (SELECT unnest(range(128)) AS k, unnest({list(_A)}::BIGINT[]) AS a, unnest({list(_B)}::BIGINT[]) AS b),
sg AS (SELECT ord, k, min((a * (('0x' || substr(md5(x), 1, 8))::BIGINT % {PRIME}) + b) % {PRIME}) AS v FROM el, perm GROUP BY ALL)
SELECT ord, string_agg(CAST(v AS VARCHAR), '-' ORDER BY k) AS signature FROM sg GROUP BY 1""")
def weighted_signatures(spark, d):
    return search.fingerprint(listings(spark, d), ASM).select("ord", F.array_join(F.transform("sig", lambda v: v.cast("string")), "-").alias("signature"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_name AS x, p_type AS y FROM part WHERE p_partkey % 5 = 0),
r AS (SELECT k, x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT) AS row FROM p
  UNION ALL SELECT k, x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda m: greatest(row[m], CASE WHEN m > 1 AND y[m - 1] = x[i + 1] THEN row[m - 1] + 1 ELSE 0 END)))) FROM r WHERE i < length(x))
SELECT k AS p_partkey, round(200.0::DOUBLE * row[-1] / (length(x) + length(y)), 6) AS edit_ratio FROM r WHERE i = length(x)""")
def edit_ratios(spark, d):
    p = table(spark, d, "part").where("p_partkey % 5 = 0")
    return p.select("p_partkey", F.round(edit.edit_ratio("p_name", "p_type"), 6).alias("edit_ratio"))


@query(f"{LISTINGS} SELECT ord, 3 AS num_blocks, CAST(CASE WHEN ord < 13 THEN 4 ELSE 3 END AS INTEGER) AS num_edges, '3,2,1' AS block_sizes FROM listing")
def flow_graphs(spark, d):
    g = listings(spark, d).select("ord", cfg.cfg_extract("code").alias("g"))
    return g.select("ord", "g.num_blocks", "g.num_edges", F.array_join(F.transform("g.block_sizes", lambda x: x.cast("string")), ",").alias("block_sizes"))


@query(f"{LISTINGS} SELECT s AS size, count(*) AS n FROM (SELECT unnest([3, 2, 1]) AS s FROM listing) GROUP BY 1")
def block_size_histogram(spark, d):
    g = listings(spark, d).select(cfg.cfg_extract("code").alias("g"))
    return g.select(F.explode("g.block_sizes").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(f"""{SIGNED}, o AS (SELECT checksum, row_number() OVER (ORDER BY checksum) AS i FROM (SELECT * FROM store WHERE checksum < '2')), p AS (SELECT a.checksum AS l, b.checksum AS r FROM o a JOIN o b ON b.i = a.i + 1),
t AS (SELECT checksum, list_distinct(regexp_extract_all(lower(code), '([a-z0-9]+)', 1)) AS t FROM store)
SELECT l AS left, r AS right, j AS jaccard, CAST(len(x.t) AS INTEGER) AS tokens_left, CAST(len(y.t) AS INTEGER) AS tokens_right, CAST(len(list_intersect(x.t, y.t)) AS INTEGER) AS shared_tokens
FROM (SELECT l, r, count(*) FILTER (WHERE a.v = b.v) / 128.0::DOUBLE AS j FROM p JOIN sg a ON a.checksum = l JOIN sg b ON b.checksum = r AND a.k = b.k GROUP BY ALL) JOIN t x ON x.checksum = l JOIN t y ON y.checksum = r""")
def compare_neighbours(spark, d):
    from pyspark.sql import Window

    s = search.fingerprint(built(spark, d, signed=False).where("checksum < '2'").drop("sig"), WORD)
    pairs = s.select(F.col("checksum").alias("left"), F.lead("checksum").over(Window.orderBy("checksum")).alias("right")).where("right is not null")
    c = search.compare(pairs, s.where(search.has_elements(F.col("sig"))), WORD, graphs=False)
    return c.select("left", "right", "jaccard", "tokens_left", "tokens_right", "shared_tokens")


@query()
def compare_scores(spark, d):
    s = store.add_batch(store.empty(spark), listings(spark, d), ASM)
    return search.compare_alike(s, ASM).select("left", "right", *(F.round(x, 6).alias(x) for x in ("jaccard", "edit_ratio", "score", "cfg_similarity")))


@query(f"WITH {STORE} SELECT checksum, array_to_string(names, ',') AS names FROM store WHERE len(list_filter(names, lambda n: contains(lower(n), '12'))) > 0 ORDER BY checksum LIMIT 50")
def search_names(spark, d):
    return store.search_names(built(spark, d, signed=False), "12").select("checksum", F.array_join("names", ",").alias("names"))


@query(f"WITH {STORE} SELECT checksum, collection FROM store WHERE list_contains(names, '42')")
def alias_lookup(spark, d):
    return store.by_name(built(spark, d, signed=False), "42").select("checksum", "collection")


@query(f"WITH {STORE}, k AS (SELECT DISTINCT checksum FROM docs WHERE doc_id % 11 = 0) SELECT checksum, CAST(length(code) AS INTEGER) AS n FROM store JOIN k USING (checksum)")
def multi_key_lookup(spark, d):
    keys = store.prepare(incoming(spark, d, "doc_id % 11 = 0"), WORD)
    return store.by_checksums(built(spark, d, signed=False), keys).select("checksum", F.length("code").alias("n"))


@query(f"""WITH {STORE}, p AS (SELECT DISTINCT prefix FROM (SELECT unnest([substr(checksum, 1, 1), substr(checksum, 1, 8), checksum, 'zz' || substr(checksum, 1, 3)]) AS prefix FROM store WHERE checksum < '3'))
SELECT prefix, CASE WHEN n = 0 THEN 'missing' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN c END AS checksum FROM (SELECT prefix, count(checksum) AS n, min(checksum) AS c FROM p LEFT JOIN store ON starts_with(checksum, prefix) GROUP BY 1)""")
def resolve_prefixes(spark, d):
    s = built(spark, d, signed=False)
    c = F.col("checksum")
    p = s.where("checksum < '3'").select(F.explode(F.array(F.substring(c, 1, 1), F.substring(c, 1, 8), c, F.concat(F.lit("zz"), F.substring(c, 1, 3)))).alias("prefix"))
    return store.resolve_prefixes(s, p)


@query(f"WITH {STORE} SELECT checksum, array_to_string(names, ',') AS names FROM store WHERE collection = 'src3'")
def collection_members(spark, d):
    return store.members(built(spark, d, signed=False), "src3").select("checksum", F.array_join("names", ",").alias("names"))


@query(f"WITH {STORE}, c AS (SELECT DISTINCT source AS name FROM documents UNION SELECT 'unused') SELECT name, 'from ' || name AS description, count(checksum) AS n_snippets FROM c LEFT JOIN store ON collection = name GROUP BY ALL")
def collection_counts(spark, d):
    names = table(spark, d, "documents").select(F.col("source").alias("name")).union(spark.range(1).select(F.lit("unused").alias("name"))).distinct()
    cols = names.select("name", F.concat(F.lit("from "), "name").alias("description"), F.lit(None).cast("timestamp").alias("created_at"))
    return store.collection_counts(built(spark, d, signed=False), cols)


@query(f"WITH {STORE} SELECT checksum, CASE WHEN collection = 'src1' THEN NULL WHEN starts_with(checksum, '0') THEN 'src2' WHEN starts_with(checksum, 'f') THEN NULL ELSE collection END AS collection FROM store")
def collection_edits(spark, d):
    s = once(built(spark, d, signed=False).select("checksum", "collection"))
    cols = spark.createDataFrame([("src1", "", None), ("src2", "", None)], store.COLLECTIONS)
    ask = s.where("startswith(checksum, '0')").select("checksum", F.lit("src2").alias("name"))
    none = s.where("startswith(checksum, '3')").select("checksum", F.lit("absent").alias("name"))
    s2 = store.collection_add(s, cols, ask.union(none))
    s2 = store.collection_remove(s2, s.where("startswith(checksum, 'f')"))
    gone = s.where("collection = 'src1'").select("checksum")
    s3, _ = store.collection_delete(s2, cols, "src1")
    return store.collection_remove(s3, gone).select("checksum", "collection")


@query(f"WITH {STORE} SELECT checksum, CAST(length(code) AS INTEGER) AS n FROM store ORDER BY checksum LIMIT 25 OFFSET 50")
def range_page(spark, d):
    return store.page(built(spark, d, signed=False), 50, 75).select("checksum", F.length("code").alias("n"))


@query(f"WITH {STORE} SELECT checksum FROM store WHERE checksum > '8' ORDER BY checksum LIMIT 20")
def keyset_page(spark, d):
    return store.after(built(spark, d, signed=False), "8", 20).select("checksum")


@query(f"WITH {STORE} SELECT checksum, array_to_string(names, ', ') AS names, array_to_string(tags, ', ') AS tags, collection, code FROM store WHERE checksum = (SELECT min(checksum) FROM store)")
def show_snippet(spark, d):
    s = built(spark, d, signed=False)
    return export.flat(s.join(s.agg(F.min("checksum").alias("checksum")), "checksum")).select("checksum", "names", "tags", "collection", "code")


@query("SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS snippet_checksum, text AS code FROM conversations WHERE conv_id = 3")
def version_history(spark, d):
    v = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").cast("string").alias("snippet_checksum"), F.col("text").alias("code"), F.timestamp_seconds("turn").alias("created_at"))
    return store.history(v, "3").select("id", "snippet_checksum", "code")


@query(f"WITH {STORE} SELECT count(*) || '-' || max(checksum) AS digest FROM store")
def state_digest(spark, d):
    return store.state_digest(built(spark, d, signed=False))


@query(f"""WITH {STORE} SELECT (SELECT count(*) FROM store) AS n_snippets, (SELECT round(avg(length(code)), 6) FROM store) AS avg_length,
(SELECT count(DISTINCT t) FROM (SELECT unnest(regexp_extract_all(lower(code), '([a-z0-9]+)', 1)) AS t FROM store)) AS vocabulary""")
def store_stats(spark, d):
    return store.stats(built(spark, d, signed=False), WORD).withColumn("avg_length", F.round("avg_length", 6))


@query(f"""{SIGNED}, s AS (SELECT checksum FROM store ORDER BY md5(checksum || '/0'), checksum LIMIT 100), p AS (SELECT a.checksum AS l, b.checksum AS r FROM s a JOIN s b ON a.checksum < b.checksum)
SELECT round(avg(j), 9) AS avg_similarity, count(*) AS n_pairs FROM (SELECT l, r, count(*) FILTER (WHERE coalesce(a.v, {PRIME}) = coalesce(b.v, {PRIME})) / 128.0::DOUBLE AS j FROM p CROSS JOIN (SELECT k FROM perm) k LEFT JOIN sg a ON a.checksum = l AND a.k = k.k LEFT JOIN sg b ON b.checksum = r AND b.k = k.k GROUP BY ALL)""")
def average_similarity(spark, d):
    return store.average_similarity(built(spark, d), WORD, 100).withColumn("avg_similarity", F.round("avg_similarity", 9))


@query(f"WITH {STORE} SELECT checksum FROM store ORDER BY md5(checksum || '/5'), checksum LIMIT 30")
def random_sample(spark, d):
    return store.sample(built(spark, d, signed=False), 30, 5).select("checksum")


_T, _S = "doc_id % 3 <> 0", "doc_id % 3 <> 1"
_MERGE = f"""WITH t AS (WITH {_STORE.format(where=_T)} SELECT * FROM store), s AS (WITH {_STORE.format(where=_S)} SELECT * FROM store)"""


@query(f"""{_MERGE} SELECT checksum, array_to_string(CASE WHEN t.names IS NULL THEN s.names WHEN s.names IS NULL THEN t.names ELSE list_sort(list_distinct(t.names || s.names)) END, ',') AS names,
array_to_string(CASE WHEN t.tags IS NULL THEN s.tags WHEN s.tags IS NULL THEN t.tags ELSE list_sort(list_distinct(t.tags || s.tags)) END, ',') AS tags, coalesce(t.collection, s.collection) AS collection FROM t FULL JOIN s USING (checksum)""")
def merge_stores(spark, d):
    m = store.merge(built(spark, d, _T), built(spark, d, _S), WORD)
    return m.select("checksum", F.array_join("names", ",").alias("names"), F.array_join("tags", ",").alias("tags"), "collection")


@query(f"""{_MERGE} SELECT count(*) AS n_source, count(*) FILTER (WHERE t.names IS NULL) AS n_new, count(*) FILTER (WHERE t.names IS NOT NULL AND (len(list_filter(s.names, lambda x: NOT list_contains(t.names, x))) > 0 OR len(list_filter(s.tags, lambda x: NOT list_contains(t.tags, x))) > 0)) AS n_updated,
count(*) FILTER (WHERE t.names IS NOT NULL AND len(list_filter(s.names, lambda x: NOT list_contains(t.names, x))) = 0 AND len(list_filter(s.tags, lambda x: NOT list_contains(t.tags, x))) = 0) AS n_skipped FROM s LEFT JOIN t USING (checksum)""")
def merge_counts(spark, d):
    c = store.merge_counts(built(spark, d, _T, signed=False), built(spark, d, _S, signed=False))
    return c.select("n_source", *(F.col(x).cast("bigint").alias(x) for x in ("n_new", "n_updated", "n_skipped")))


@query(f"WITH {STORE} SELECT checksum FROM store WHERE NOT starts_with(checksum, 'a')")
def delete_snippets(spark, d):
    s = built(spark, d, signed=False)
    return store.delete(s, s.where("startswith(checksum, 'a')")).select("checksum")


@query(f"WITH {STORE} SELECT checksum, array_to_string(CASE WHEN starts_with(checksum, '1') THEN names || ['extra'] WHEN starts_with(checksum, '2') AND len(names) > 1 THEN names[2:] ELSE names END, ',') AS names FROM store")
def name_edits(spark, d):
    s = once(built(spark, d, signed=False).select("checksum", "names"))
    s1, _ = store.name_add(s, s.where("startswith(checksum, '1')").select("checksum", F.lit("extra").alias("name")))
    s2, _ = store.name_remove(s1, s.where("startswith(checksum, '2')").select("checksum", F.col("names")[0].alias("name")))
    return s2.select("checksum", F.array_join("names", ",").alias("names"))


@query(f"WITH {STORE} SELECT status, count(*) AS n FROM (SELECT CASE WHEN len(names) < 2 THEN 'last' ELSE 'removed' END AS status FROM store UNION ALL SELECT 'missing') GROUP BY 1")
def name_outcomes(spark, d):
    s = once(built(spark, d, signed=False).select("checksum", "names"))
    ask = s.select("checksum", F.col("names")[0].alias("name")).union(spark.range(1).select(F.lit("none").alias("checksum"), F.lit("x").alias("name")))
    return store.name_remove(s, ask)[1].groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {STORE} SELECT checksum, array_to_string(CASE WHEN starts_with(checksum, '1') THEN list_sort(list_distinct(tags || ['new'])) WHEN starts_with(checksum, '2') THEN list_filter(tags, lambda x: x <> 'en') ELSE tags END, ',') AS tags FROM store")
def tag_edits(spark, d):
    s = once(built(spark, d, signed=False).select("checksum", "tags"))
    s1 = store.tag_add(s, s.where("startswith(checksum, '1')").select("checksum", F.lit(" new ").alias("tag")).union(s.select("checksum", F.lit("  ").alias("tag"))))
    s2 = store.tag_remove(s1, s.where("startswith(checksum, '2')").select("checksum", F.lit("en").alias("tag")))
    return s2.select("checksum", F.array_join("tags", ",").alias("tags"))


@query(f"{SIGNED} SELECT checksum, count(*) = 128 AS same FROM sg GROUP BY 1")
def reindex(spark, d):
    s = signatures(spark, d).where(search.has_elements(F.col("sig")))
    again = store.reindex(built(spark, d, signed=False), WORD).select("checksum", F.col("sig").alias("again"))
    return s.join(again, "checksum").select("checksum", (F.col("sig") == F.col("again")).alias("same"))


@query(f"{SIGNED} SELECT (SELECT count(*) FROM store) AS n_snippets, 0::BIGINT AS n_bad, {B} * count(DISTINCT checksum) AS n_index_rows, {B} * count(DISTINCT checksum) AS n_expected, 0 AS n_issues, 0 AS n_warnings FROM sg")
def verify_store(spark, d):
    s = signatures(spark, d)
    return store.verify(s, WORD, search.band_index(s, WORD), WORD.fingerprint_key).withColumn("n_bad", F.col("n_bad").cast("bigint"))


@query(f"""{SIGNED}, {_BANDS.format(b=B, r=R)} SELECT CAST(band AS INTEGER) AS band, count(*) AS n FROM bands WHERE NOT starts_with(checksum, 'a') GROUP BY 1""")
def index_sync(spark, d):
    s = signatures(spark, d)
    half = search.band_index(s.where("checksum < '8'"), WORD)
    index = store.index_add(half, s, WORD)
    return store.index_remove(index, s.where("startswith(checksum, 'a')")).groupBy("band").agg(F.count("*").alias("n"))


@query(f"WITH {STORE} SELECT checksum, names[1] || '.asm' AS file_name FROM store")
def export_names(spark, d):
    return export.export_names(built(spark, d, signed=False))


@query(f"""WITH {STORE} SELECT checksum, 'rule simlake_r_' || names[1] || '_' || substr(checksum, 1, 8) || ' {{' || chr(10) || '  meta:' || chr(10) || '    description = "' || names[1] || '"' || chr(10) || '    checksum = "' || checksum || '"' || chr(10) || '  strings:' || chr(10) || '    $text = "'
 || replace(replace(replace(replace(code, '\\', '\\\\'), '"', '\\"'), chr(13), '\\r'), chr(10), '\\n') || '" nocase ascii wide' || chr(10) || '  condition:' || chr(10) || '    $text' || chr(10) || '}}' || chr(10) AS rule FROM store""")
def export_yara(spark, d):
    return export.yara_rules(built(spark, d, signed=False))


@query(f"""WITH {STORE} SELECT checksum, '{{"names":' || to_json(names) || ',"collection":' || to_json(collection) || '}}' AS json FROM store""")
def render_json(spark, d):
    s = built(spark, d, signed=False)
    return s.select("checksum", F.to_json(F.struct("names", "collection")).alias("json"))


@query(f"SELECT * FROM (VALUES {', '.join(f'({t}::DOUBLE, {b}, {r})' for t, b, r in ((0.2, 28, 2), (0.3, 37, 3), (0.5, 25, 5), (0.7, 14, 9), (0.8, 9, 13), (0.9, 5, 25), (0.95, 3, 42), (0.0, 128, 1)))}) AS t(threshold, bands, rows)")
def banding_parameters(spark, d):
    from ..params import banding

    return spark.createDataFrame([(t, *banding(t, 128)) for t in (0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.0)], "threshold double, bands int, rows int")
