"""The snippet store as DataFrames: every operation takes tables and returns new ones, to be written as the caller chooses.

snippets(checksum string, names array<string>, code string, sig array<bigint>, tags array<string>, collection string);
collections(name string, description string, created_at timestamp); versions(id, snippet_checksum, code, sig, created_at).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.signature import jaccard
from ..params import TOLERANCE, SearchParams
from .once import once
from .search import band_index, fingerprint

SNIPPETS = "checksum string, names array<string>, code string, sig array<bigint>, tags array<string>, collection string"
COLLECTIONS = "name string, description string, created_at timestamp"
VERSIONS = "id bigint, snippet_checksum string, code string, sig array<bigint>, created_at timestamp"


def empty(spark: SparkSession, schema: str = SNIPPETS) -> DataFrame:
    """A table without rows, of which the optimiser knows it, so that joins with it go."""
    kinds = T._parse_datatype_string(schema)
    return spark.range(1).where(F.lit(False)).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields))


def prepare(df: DataFrame, p: SearchParams) -> DataFrame:
    """(ord, name, code, tag, collection, checksum) of rows that aren't blank. df has name and code; ord, tag and collection if it likes."""
    have = set(df.columns)
    opt = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    own = df.select((F.col("ord") if "ord" in have else F.col("name")).alias("ord"), "name", "code", opt("tag", "string"), opt("collection", "string"))
    return own.where(text.has_text(F.col("code"), p.tokenizer)).withColumn("checksum", text.checksum_of_text(F.col("code"), p.tokenizer))


def _ordered_names(pairs: Column) -> Column:
    """Distinct names of (ord, name) structs, in the order of first sight."""
    return F.array_distinct(F.filter(F.transform(F.sort_array(pairs), lambda x: x["name"]), lambda n: n.isNotNull()))


def group_prepared(prepared: DataFrame) -> DataFrame:
    """One row per checksum: first code, distinct names in order, sorted tags, first collection."""
    first = F.struct("ord", "code")
    return prepared.groupBy("checksum").agg(
        F.min(first)["code"].alias("code"),
        _ordered_names(F.collect_list(F.struct("ord", "name"))).alias("names"),
        F.sort_array(F.collect_set("tag")).alias("tags"),
        F.min(F.when(F.col("collection").isNotNull(), F.struct("ord", "collection")))["collection"].alias("collection"),
    )


def append_distinct(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(a, b))


def sorted_union(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def add_batch(store: DataFrame, incoming: DataFrame, p: SearchParams) -> DataFrame:
    """The store with incoming rows: new checksums are fingerprinted and inserted, known ones get the new names behind their own."""
    new = group_prepared(prepare(incoming, p))
    fresh = fingerprint(new.join(store.select("checksum"), "checksum", "left_anti"), p).select("checksum", "names", "code", "sig", "tags", "collection")
    more = new.select("checksum", F.col("names").alias("more"))
    kept = store.join(more, "checksum", "left").withColumn("names", F.when(F.col("more").isNull(), F.col("names")).otherwise(append_distinct(F.col("names"), F.coalesce("more", F.array().cast("array<string>")))))
    return kept.select("checksum", "names", "code", "sig", "tags", "collection").union(fresh)


def add_counts(store: DataFrame, incoming: DataFrame, p: SearchParams) -> DataFrame:
    """(n_input, n_added, n_aliased, n_skipped): checksums inserted, checksums known before, and rows beyond one per checksum."""
    rows = prepare(incoming, p)
    known = store.select("checksum", F.lit(1).alias("known"))
    per = rows.groupBy("checksum").agg(F.count("*").alias("n")).join(known, "checksum", "left")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_input"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)), F.lit(0)).alias("n_added"),
        F.coalesce(F.sum(F.when(F.col("known").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("n_aliased"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_skipped"),
    )


def delete(store: DataFrame, checksums: DataFrame) -> DataFrame:
    return store.join(checksums.select("checksum"), "checksum", "left_anti")


def _outcome(store: DataFrame, request: DataFrame, value: str) -> DataFrame:
    return store.join(request.select("checksum", value), "checksum", "right")


def name_add(store: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, outcomes) of (checksum, name) requests: missing, duplicate or added. Several for one snippet are added in order of their names; equal ones count once."""
    out = _outcome(store, request.select("checksum", "name").distinct(), "name").select("checksum", "name", F.when(F.col("names").isNull(), "missing").when(F.array_contains("names", F.col("name")), "duplicate").otherwise("added").alias("status"))
    more = out.where("status = 'added'").groupBy("checksum").agg(F.sort_array(F.collect_set("name")).alias("more"))
    return store.join(more, "checksum", "left").withColumn("names", F.when(F.col("more").isNull(), F.col("names")).otherwise(F.concat("names", "more"))).drop("more"), out


def name_remove(store: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As name_add: missing, unknown, last (a snippet keeps one name: of requests for all of them, that for the last in order) or removed."""
    own = _outcome(store, request.select("checksum", "name").distinct(), "name").withColumn("known", F.coalesce(F.array_contains("names", F.col("name")), F.lit(False)))
    k = F.row_number().over(Window.partitionBy("checksum", "known").orderBy("name"))
    status = F.when(F.col("names").isNull(), "missing").when(~F.col("known"), "unknown").when(k >= F.size("names"), "last").otherwise("removed")
    out = own.select("checksum", "name", status.alias("status"))
    less = out.where("status = 'removed'").groupBy("checksum").agg(F.collect_set("name").alias("less"))
    return store.join(less, "checksum", "left").withColumn("names", F.when(F.col("less").isNull(), F.col("names")).otherwise(F.filter("names", lambda x: ~F.array_contains("less", x)))).drop("less"), out


def tag_add(store: DataFrame, request: DataFrame) -> DataFrame:
    """The store with (checksum, tag) requests; tags are stripped, sorted and distinct, blank ones do nothing."""
    more = request.select("checksum", F.trim("tag").alias("tag")).where("tag != ''").groupBy("checksum").agg(F.collect_set("tag").alias("more"))
    return store.join(more, "checksum", "left").withColumn("tags", F.when(F.col("more").isNull(), F.col("tags")).otherwise(sorted_union(F.coalesce("tags", F.array().cast("array<string>")), F.col("more")))).drop("more")


def tag_remove(store: DataFrame, request: DataFrame) -> DataFrame:
    less = request.select("checksum", F.trim("tag").alias("tag")).groupBy("checksum").agg(F.collect_set("tag").alias("less"))
    return store.join(less, "checksum", "left").withColumn("tags", F.when(F.col("less").isNull(), F.col("tags")).otherwise(F.array_except("tags", "less"))).drop("less")


def collection_create(collections: DataFrame, name: str, description: str = "") -> DataFrame:
    """A name that is taken stays as it is."""
    new = collections.sparkSession.createDataFrame([(name, description)], "name string, description string").withColumn("created_at", F.current_timestamp())
    return collections.union(new.join(collections.select("name"), "name", "left_anti").select("name", "description", "created_at"))


def collection_delete(store: DataFrame, collections: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Members stay, without a collection."""
    return store.withColumn("collection", F.when(F.col("collection") == name, None).otherwise(F.col("collection"))), collections.where(F.col("name") != name)


def collection_add(store: DataFrame, collections: DataFrame, request: DataFrame) -> DataFrame:
    """(checksum, name) requests of which both exist take effect; of several for one snippet, that of the greatest name."""
    ok = request.join(collections.select("name"), "name", "left_semi").groupBy("checksum").agg(F.max("name").alias("put"))
    return store.join(ok, "checksum", "left").withColumn("collection", F.coalesce("put", "collection")).drop("put")


def collection_remove(store: DataFrame, checksums: DataFrame) -> DataFrame:
    gone = checksums.select("checksum").distinct().withColumn("gone", F.lit(True))
    return store.join(gone, "checksum", "left").withColumn("collection", F.when(F.col("gone"), None).otherwise(F.col("collection"))).drop("gone")


def collection_counts(store: DataFrame, collections: DataFrame) -> DataFrame:
    n = store.where("collection is not null").groupBy("collection").agg(F.count("*").alias("n"))
    return collections.join(n, collections["name"] == n["collection"], "left").select("name", "description", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_snippets"))


def members(store: DataFrame, collection: str) -> DataFrame:
    return store.where(F.col("collection") == collection)


def merge(target: DataFrame, source: DataFrame, p: SearchParams) -> DataFrame:
    """Full reconciliation. New snippets come as they are, fingerprinted anew where the signature is missing or of another length;
    known ones get sorted unions of names and tags, and the source's collection where they have none."""
    sig_ok = F.col("sig").isNotNull() & (F.size("sig") == p.num_perm)
    new = source.join(target.select("checksum"), "checksum", "left_anti")
    cols = ["checksum", "names", "code", "sig", "tags", "collection"]
    lacks = F.coalesce(~sig_ok, F.lit(True))
    new = new.withColumn("lacking", F.when(lacks, F.col("code"))).where(~lacks | text.canonical_text(F.col("lacking")).isNotNull())
    new = fingerprint(new, p, "lacking", "redone").withColumn("sig", F.when(lacks, F.col("redone")).otherwise(F.col("sig"))).select(*cols)
    s = source.select("checksum", F.col("names").alias("s_names"), F.col("tags").alias("s_tags"), F.col("collection").alias("s_coll"))
    both = target.join(s, "checksum", "left")
    none = F.array().cast("array<string>")
    known = F.col("s_names").isNotNull()
    both = both.withColumns({
        "names": F.when(known, sorted_union(F.col("names"), F.coalesce("s_names", none))).otherwise(F.col("names")),
        "tags": F.when(known, sorted_union(F.coalesce("tags", none), F.coalesce("s_tags", none))).otherwise(F.col("tags")),
        "collection": F.coalesce("collection", "s_coll"),
    })
    return both.select(*cols).union(new)


def merge_counts(target: DataFrame, source: DataFrame) -> DataFrame:
    """(n_source, n_new, n_updated, n_skipped): a known snippet counts as updated if its names or tags grow."""
    t = target.select("checksum", F.col("names").alias("t_names"), F.col("tags").alias("t_tags"))
    j = source.join(t, "checksum", "left")
    grows = (F.size(F.array_except("names", "t_names")) > 0) | (F.size(F.array_except("tags", "t_tags")) > 0)
    kind = F.when(F.col("t_names").isNull(), "new").when(grows, "updated").otherwise("skipped")
    n = lambda k: F.coalesce(F.sum(F.when(kind == k, 1).otherwise(0)), F.lit(0)).alias(f"n_{k}")
    return j.agg(F.count("*").alias("n_source"), n("new"), n("updated"), n("skipped"))


def merge_collections(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.union(source.join(target.select("name"), "name", "left_anti").select("name", "description", "created_at"))


def reindex(store: DataFrame, p: SearchParams) -> DataFrame:
    """All signatures anew. Doing it twice changes nothing."""
    return fingerprint(store.drop("sig"), p).select("checksum", "names", "code", "sig", "tags", "collection")


def needs_reindex(stamp: dict[str, str] | None, p: SearchParams) -> bool:
    """Whether fingerprints stamped so can't be searched with these parameters."""
    return stamp != p.fingerprint_key


def index_matches(stamp: tuple[float, int] | None, p: SearchParams) -> bool:
    return stamp is not None and abs(stamp[0] - p.threshold) <= TOLERANCE and stamp[1] == p.num_perm


def verify(store: DataFrame, p: SearchParams, index: DataFrame | None = None, stamp: dict[str, str] | None = None) -> DataFrame:
    """One row: snippets, bad signatures, index rows found and expected, issues (which need repair) and warnings."""
    b, _ = p.bands
    bad = F.col("sig").isNull() | (F.size("sig") != p.num_perm)
    s = store.agg(F.count("*").alias("n_snippets"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("n_bad"), F.coalesce(F.sum((~bad & (F.array_min("sig") < F.lit((1 << 31) - 1))).cast("bigint")), F.lit(0)).alias("n_indexable"))
    found = index.where("band = 0").agg((F.count("*") * b).alias("n_index_rows")) if index is not None else store.sparkSession.createDataFrame([(None,)], "n_index_rows bigint")
    issue = (F.col("n_index_rows").isNotNull() & (F.col("n_index_rows") != F.col("n_expected"))).cast("int") + (F.col("n_bad") > 0).cast("int")
    warn = F.lit(int(index is None) + int(stamp is not None and needs_reindex(stamp, p)))
    return s.crossJoin(found).withColumn("n_expected", F.col("n_indexable") * b).select("n_snippets", "n_bad", "n_index_rows", "n_expected", issue.alias("n_issues"), warn.alias("n_warnings"))


def stats(store: DataFrame, p: SearchParams) -> DataFrame:
    """(n_snippets, avg_length, vocabulary): all rows; 0 where there are none."""
    n = store.agg(F.count("*").alias("n_snippets"), F.coalesce(F.avg(F.length("code")), F.lit(0.0)).alias("avg_length"))
    words = store.select(F.explode(F.array_distinct(text.tokens(F.col("code"), p.tokenizer))).alias("t")).agg(F.countDistinct("t").alias("vocabulary"))
    return n.crossJoin(words)


def sample(store: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of their checksum: the same for the same seed, whatever the partitioning."""
    return store.orderBy(F.md5(F.concat("checksum", F.lit(f"/{seed}")).cast("binary")), "checksum").limit(n)


def average_similarity(store: DataFrame, p: SearchParams, n: int = 100, seed: int = 0) -> DataFrame:
    """(avg_similarity, n_pairs) of all pairs of a sample; 1.0 where there is no pair, 0.0 in an empty store. Signatures of another length are left out."""
    s = once(sample(store.select("checksum", "sig").where(F.size("sig") == p.num_perm), n, seed))
    a, b = s.select(F.col("checksum").alias("a"), F.col("sig").alias("x")), s.select(F.col("checksum").alias("b"), F.col("sig").alias("y"))
    mean = a.join(b, F.col("a") < F.col("b")).agg(F.avg(jaccard(F.col("x"), F.col("y"))).alias("m"), F.count("*").alias("n_pairs"))
    any_row = store.agg((F.count("*") > 0).alias("some"))
    return mean.crossJoin(any_row).select(F.when(~F.col("some"), 0.0).otherwise(F.coalesce("m", F.lit(1.0))).alias("avg_similarity"), "n_pairs")


def state_digest(store: DataFrame) -> DataFrame:
    """(digest): count and greatest checksum, or 'empty'."""
    return store.agg(F.when(F.count("*") == 0, "empty").otherwise(F.concat(F.count("*").cast("string"), F.lit("-"), F.max("checksum"))).alias("digest"))


def search_names(store: DataFrame, part: str, limit: int = 50) -> DataFrame:
    """Snippets with a name that contains the text, whatever its case, in order of checksum."""
    return store.where(F.exists("names", lambda n: F.contains(F.lower(n), F.lower(F.lit(part))))).orderBy("checksum").limit(limit)


def by_name(store: DataFrame, name: str) -> DataFrame:
    return store.where(F.array_contains("names", name))


def by_checksum(store: DataFrame, checksum: str) -> DataFrame:
    return store.where(F.col("checksum") == checksum)


def by_checksums(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("checksum").distinct(), "checksum", "left_semi")


def resolve_prefixes(store: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, status, checksum): the exact checksum, else the only one that begins so; missing or ambiguous otherwise.

    Prefixes are joined on their first six digits where they have as many; shorter ones, which match much of a store, are compared with all.
    """
    own = prefixes.select(F.lower(F.trim("prefix")).alias("prefix")).distinct()
    six = F.substring("checksum", 1, 6)
    s = store.select("checksum", six.alias("six"))
    long = own.where("length(prefix) >= 6").withColumn("six", F.substring("prefix", 1, 6)).join(s, "six").where(F.expr("startswith(checksum, prefix)")).select("prefix", "checksum")
    short = own.where("length(prefix) between 1 and 5").join(s, F.expr("startswith(checksum, prefix)")).select("prefix", "checksum")
    hits = long.union(short).groupBy("prefix").agg(F.count("*").alias("n"), F.min("checksum").alias("first"), F.max(F.when(F.col("checksum") == F.col("prefix"), F.col("checksum"))).alias("exact"))
    out = own.join(hits, "prefix", "left")
    one = F.coalesce("exact", F.when(F.col("n") == 1, F.col("first")))
    return out.select("prefix", F.when(one.isNotNull(), "found").when(F.col("n").isNull(), "missing").otherwise("ambiguous").alias("status"), one.alias("checksum"))


def page(store: DataFrame, start: int, end: int) -> DataFrame:
    """Rows [start, end) in order of checksum; (0, 0) is all of them."""
    if start < 0 or end < start:
        raise ValueError("0 <= start <= end")
    ordered = store.orderBy("checksum")
    return ordered if start == end == 0 else ordered.offset(start).limit(end - start)


def after(store: DataFrame, checksum: str, n: int) -> DataFrame:
    """Keyset paging: the next n rows."""
    return store.where(F.col("checksum") > checksum).orderBy("checksum").limit(n)


def history(versions: DataFrame, checksum: str) -> DataFrame:
    return versions.where(F.col("snippet_checksum") == checksum).orderBy(F.col("created_at").desc(), F.col("id").desc())


def clean(index: DataFrame) -> DataFrame:
    """An index without rows; the store is not touched."""
    return index.limit(0)


def rebuild_index(store: DataFrame, p: SearchParams) -> DataFrame:
    return band_index(store, p)


def index_add(index: DataFrame, added: DataFrame, p: SearchParams) -> DataFrame:
    """The index with rows of added snippets that it lacks."""
    return index.union(band_index(added, p).join(index.select("checksum").distinct(), "checksum", "left_anti").select("band", "bucket", "checksum"))


def index_remove(index: DataFrame, checksums: DataFrame) -> DataFrame:
    return index.join(checksums.select("checksum"), "checksum", "left_anti").select("band", "bucket", "checksum")
