"""Fingerprints, the band index, candidate joins, ranking and comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cfg, edit, text
from ..functions.fingerprints import give_back, signature_udf
from ..functions.signature import band_keys, jaccard
from ..params import SearchParams
from .once import once

#: A query side of at most so many rows is broadcast to the index; a larger one is joined by shuffle.
BROADCAST_QUERIES = 2000


def separate_lines(query: Column) -> Column:
    """A one-line query may part its instructions by semicolons."""
    return F.when(F.instr(query, "\n") > 0, query).otherwise(F.regexp_replace(query, ";", "\n"))


def fingerprint(df: DataFrame, p: SearchParams, source: str = "code", out: str = "sig") -> DataFrame:
    """df with a signature column."""
    return df.withColumn(out, signature_udf(p)(F.col(source)))


def has_elements(sig: Column) -> Column:
    """Whether a signature was taken over anything."""
    return F.array_min(sig) < F.lit((1 << 31) - 1)


def band_index(store: DataFrame, p: SearchParams, key: str = "checksum") -> DataFrame:
    """(band, bucket, key): a row for each band of each valid signature."""
    b, r = p.bands
    valid = store.where(F.col("sig").isNotNull() & (F.size("sig") == p.num_perm) & has_elements(F.col("sig")))
    return valid.select(F.col(key), F.posexplode(band_keys(F.col("sig"), b, r)).alias("band", "bucket")).select("band", "bucket", key)


def _valid(df: DataFrame, key: str, p: SearchParams) -> DataFrame:
    return df.where(F.col("sig").isNotNull() & (F.size("sig") == p.num_perm) & has_elements(F.col("sig"))).select(key, "sig")


def _band_hashes(sig: Column, p: SearchParams) -> Column:
    """A number for each band; snippets of one bucket have equal ones."""
    b, r = p.bands
    return F.explode(F.array(*(F.xxhash64(F.lit(i), F.slice(sig, i * r + 1, r)) for i in range(b)))).alias("band")


def _matrix(sigs: pa.ChunkedArray | pa.Array, p: SearchParams) -> np.ndarray:
    sigs = sigs.combine_chunks() if isinstance(sigs, pa.ChunkedArray) else sigs
    return sigs.flatten().to_numpy().reshape(len(sigs), p.num_perm).astype(np.uint32)


def _buckets(own: np.ndarray, part: np.ndarray, p: SearchParams) -> np.ndarray:
    """(bands, rows): rows of one part that agree in a band have equal numbers there."""
    b, r = p.bands
    out = np.empty((b, len(own)), np.int32)
    for i in range(b):
        key = np.ascontiguousarray(np.concatenate([part.astype(np.uint32)[:, None], own[:, i * r : i * r + r]], 1)).view(f"V{4 * r + 4}")[:, 0]
        out[i] = np.unique(key, return_inverse=True)[1]
    return out


def _together(x: np.ndarray, y: np.ndarray, end: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns of x and y that are equal in a row, some at a time. With `end`, x is y, and a column is held against later ones before its end."""
    lo = 0
    while lo < x.shape[1]:
        first = lo + 1 if end is not None else 0
        hi = lo + max(1, CELLS // max(1, y.shape[1] if end is None else int(end[lo]) - lo))
        hi = min(hi, x.shape[1])
        last = y.shape[1] if end is None else int(end[hi - 1])
        while end is not None and hi > lo + 1 and (hi - lo) * (last - lo) > 2 * CELLS:
            hi = lo + (hi - lo) // 2
            last = int(end[hi - 1])
        same = np.zeros((hi - lo, max(0, last - first)), bool)
        for i in range(len(x)):
            same |= x[i, lo:hi, None] == y[i, None, first:last]
        i, j = np.nonzero(same)
        i, j = i + lo, j + first
        if end is not None:
            i, j = i[i < j], j[i < j]
        yield i, j
        lo = hi


def _agreement(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """jaccard() of rows i of x and j of y."""
    return np.concatenate([np.zeros(0), *((x[i[k : k + 20_000]] == y[j[k : k + 20_000]]).mean(1) for k in range(0, len(i), 20_000))])


#: Comparisons of buckets that are held at once; rows that a function gets at least, of one lead or more.
CELLS, ROWS = 1 << 22, 1000


def _scored_few(queries: DataFrame, store: DataFrame, p: SearchParams) -> DataFrame:
    """scored_candidates() for up to BROADCAST_QUERIES queries, whose signatures go to every task: the store is read once and nothing moves."""
    kind = queries.schema["query_id"]
    asked = queries.toArrow()
    ids, theirs = asked["query_id"].combine_chunks(), _matrix(asked["sig"], p)

    def each(batches):
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                own = _matrix(b.column(1).slice(k, ROWS), p)
                if not len(theirs):
                    continue
                both = _buckets(np.concatenate([own, theirs]), np.zeros(len(own) + len(theirs)), p)
                for i, j in _together(both[:, : len(own)], both[:, len(own) :]):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), b.column(0).take(pa.array(i + k)), pa.array(_agreement(own, theirs, i, j))], ["query_id", "checksum", "jaccard"])

    return store.mapInArrow(each, T.StructType([kind, T.StructField("checksum", T.StringType()), T.StructField("jaccard", T.DoubleType())]))


def scored_candidates(queries: DataFrame, store: DataFrame, p: SearchParams, few: bool = False) -> DataFrame:
    """(query_id, checksum, jaccard) of stored snippets that share a bucket with a query; texts are fetched once ranking needs them. `few` says that the queries' number has been checked.

    What shares a bucket meets at the bucket's least stored checksum, to which a signature moves once and not once for each pair; buckets of one cluster mostly share it.
    """
    asked, own = once(_valid(queries, "query_id", p)), _valid(store, "checksum", p)
    if few:
        return _scored_few(asked, own, p)
    own = once(own)
    kind = queries.schema["query_id"]
    rows = own.select(F.lit(None).cast(kind.dataType).alias("query_id"), "checksum", _band_hashes(F.col("sig"), p)).union(asked.select("query_id", F.lit(None).cast("string").alias("checksum"), _band_hashes(F.col("sig"), p)))
    w = Window.partitionBy("band")
    rows = rows.withColumns({"lead": F.min("checksum").over(w), "n": F.count("query_id").over(w)}).where("lead is not null and n > 0").select("lead", "query_id", "checksum").distinct()
    mine = rows.where("checksum is not null").join(own, "checksum").select("lead", "query_id", "checksum", "sig")
    rows = mine.union(rows.where("checksum is null").join(asked, "query_id").select("lead", "query_id", "checksum", "sig"))

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        stored = t["checksum"].is_valid().to_numpy()
        part = t["lead"].combine_chunks().dictionary_encode().indices.to_numpy()
        sig = _matrix(t["sig"], p)
        both = _buckets(sig, part, p)
        ids, sums = t["query_id"].combine_chunks(), t["checksum"].combine_chunks()
        q, s = np.flatnonzero(~stored), np.flatnonzero(stored)
        for i, j in _together(both[:, q], both[:, s]):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[i])), sums.take(pa.array(s[j])), pa.array(_agreement(sig, sig, q[i], s[j]))], ["query_id", "checksum", "jaccard"])

    schema = T.StructType([kind, T.StructField("checksum", T.StringType()), T.StructField("jaccard", T.DoubleType())])
    return by_key(rows, "lead", pairs, schema, least=ROWS).dropDuplicates(["query_id", "checksum"])


def candidates(queries: DataFrame, store: DataFrame, p: SearchParams, few: bool = False) -> DataFrame:
    """(query_id, checksum): stored snippets that share a bucket with a query."""
    return scored_candidates(queries, store, p, few).select("query_id", "checksum")


def candidate_counts(queries: DataFrame, store: DataFrame, p: SearchParams) -> DataFrame:
    """(query_id, n_candidates), 0 for queries without any."""
    n = candidates(queries, store, p).groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_candidates"))


def _rank(df: DataFrame, by: Column, n: int, out: str = "rank") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(by.desc(), F.col("checksum").asc())
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def _reach(code: str) -> tuple[int, np.ndarray, np.ndarray]:
    """What bounds a text's edit ratios: its length and counts of its pairs and groups of four characters, told apart by a hash."""
    cp = np.frombuffer(code.encode("utf-32-le", "surrogatepass"), np.uint32)
    two = cp[:-1] * np.uint32(0x9E3779B1) + cp[1:]
    four = two[:-2] * np.uint32(0x85EBCA77) + two[2:]
    return len(cp), *(np.bincount((g * np.uint32(0xC2B2AE3D)) >> np.uint32(32 - bits), minlength=1 << bits).astype(np.int32) for g, bits in ((two, 10), (four, 12)))


def _most(x: tuple, y: tuple) -> float:
    """An upper bound of the edit ratio. A character put in or taken out changes counts of groups of q by 2 q - 1 at most."""
    n = x[0] + y[0]
    apart = max(abs(x[0] - y[0]), np.abs(x[1] - y[1]).sum() / 3, np.abs(x[2] - y[2]).sum() / 7)
    return 100.0 * (1 - apart / n) if n else 100.0


def best_of(code: str, like: list[tuple[float, str, str]], p: SearchParams, reach: Callable[[str], tuple], prune: bool = True) -> list[tuple[str, float, float, float]]:
    """(checksum, jaccard, edit ratio, score) of the top_n of (jaccard, checksum, text) for a query. Edit ratios are taken in the order of what the scores can be at most, until no other one can be among the best."""
    w = p.jaccard_weight
    bound = [100 * w * j + (1 - w) * (_most(reach(code), reach(text)) if prune else 100.0) for j, _, text in like]
    found: list[tuple[float, str, float, float]] = []
    for k in sorted(range(len(like)), key=lambda k: -bound[k]):
        if prune and len(found) == p.top_n and bound[k] < -found[-1][0] - 1e-6:
            break
        j, checksum, text = like[k]
        n = len(code) + len(text)
        least = int(n * (-found[-1][0] - 1e-6 - 100 * w * j) / (1 - w) / 200) if prune and len(found) == p.top_n and w < 1 else 0
        common = edit.lcs(code, text, least)
        if common < 0:
            continue
        e = 200.0 * common / n if n else 100.0
        found = sorted([*found, (-(j * (100.0 * w) + e * (1.0 - w)), checksum, j, e)])[: p.top_n]
    return [(c, j, e, -score) for score, c, j, e in found]


def find(queries: DataFrame, store: DataFrame, p: SearchParams, prune: bool = True) -> DataFrame:
    """(query_id, rank, checksum, names, jaccard, edit_ratio, score): the top_n of each query by score, ties by checksum.

    queries has (query_id, code, sig). With prune, edit ratios are taken only where they can matter (best_of()). That changes no result. A query and its candidates meet at the least of them, to which a text
    moves once; a query's text that occurs again there is answered once.
    """
    kind = queries.schema["query_id"]
    schema = T.StructType([kind, T.StructField("rank", T.IntegerType()), T.StructField("checksum", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("jaccard", "edit_ratio", "score"))])
    out = ["query_id", "rank", "checksum", "names", "jaccard", "edit_ratio", "score"]
    if p.top_n <= 0:
        return queries.sparkSession.createDataFrame([], schema).join(store.select("checksum", "names").limit(0), "checksum").select(*out)
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES
    # Queries of one text have one answer, that of the least of them.
    asked = queries.select("query_id", "code", "sig")
    if not few:
        asked = asked.withColumn("as", F.min("query_id").over(Window.partitionBy(F.sha2(F.col("code").cast("binary"), 256))))
    asked = once(asked)
    first = asked if few else asked.where(F.col("query_id") == F.col("as"))
    scored = once(scored_candidates(first, store, p, few))
    place = scored.groupBy("query_id").agg(F.min("checksum").alias("lead"))
    pairs = scored.join(place, "query_id")
    if few:
        # Candidates of few queries are dealt out; the best of each deal are ranked below.
        pairs = pairs.withColumn("lead", F.concat_ws("/", "lead", F.pmod(F.xxhash64("checksum"), F.lit(64))))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    texts = pairs.select("lead", "checksum").distinct().join(store.select("checksum", "code"), "checksum").select("lead", none("query_id", kind.dataType), "checksum", none("jaccard", "double"), "code")
    questions = pairs.select("lead", "query_id").distinct().join(asked.select("query_id", "code"), "query_id").select("lead", "query_id", none("checksum", "string"), none("jaccard", "double"), "code")
    rows = texts.union(questions).union(pairs.select("lead", "query_id", "checksum", "jaccard", none("code", "string")))

    def best(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, sums, codes, like = t["query_id"].combine_chunks(), t["checksum"].to_pylist(), t["code"].to_pylist(), t["jaccard"].to_pylist()
        number = ids.dictionary_encode().indices.to_pylist()
        text = {c: x for c, x, n in zip(sums, codes, number) if n is None}
        question, each, seen, made = {}, {}, {}, {}
        for i, n in enumerate(number):
            if n is not None and sums[i] is None:
                question[n] = i
            elif n is not None:
                each.setdefault(n, []).append((like[i], sums[i], text[sums[i]]))

        def reach(code: str) -> tuple:
            if code not in seen:
                if len(seen) > 2000:
                    seen.clear()
                seen[code] = _reach(code)
            return seen[code]

        for n, own in each.items():
            i = question[n]
            made[i] = best_of(codes[i], own, p, reach, prune)
        flat = [(i, k + 1, *r) for i, rs in made.items() for k, r in enumerate(rs)]
        if flat:
            cols = list(zip(*flat))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), *(pa.array(c, pa.float64()) for c in cols[3:])], schema.names)

    found = by_key(rows, "lead", best, schema)
    if few:
        found = _rank(found.drop("rank"), F.col("score"), p.top_n)
    else:
        found = found.withColumnRenamed("query_id", "as").join(asked.select("query_id", "as"), "as")
    return found.join(store.select("checksum", "names"), "checksum").select(*out)


def similar_pairs(store: DataFrame, p: SearchParams, least: float | None = None) -> DataFrame:
    """(left, right, jaccard): stored pairs that share a bucket, left < right, of at least the given similarity (the threshold). They meet as in scored_candidates()."""
    own = once(_valid(store, "checksum", p))
    w = Window.partitionBy("band")
    rows = own.select("checksum", _band_hashes(F.col("sig"), p)).withColumns({"lead": F.min("checksum").over(w), "last": F.max("checksum").over(w)})
    rows = rows.where("lead < last").select("lead", "checksum").distinct().join(own, "checksum").select("lead", "checksum", "sig")
    bar = p.threshold if least is None else least

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        part = t["lead"].combine_chunks().dictionary_encode().indices.to_numpy()
        sig, sums = _matrix(t["sig"], p), t["checksum"].combine_chunks()
        both = _buckets(sig, part, p)
        for i, j in _together(both, both, np.searchsorted(part, part, "right")):
            like = _agreement(sig, sig, i, j)
            i, j, like = i[like >= bar], j[like >= bar], like[like >= bar]
            yield pa.RecordBatch.from_arrays([sums.take(pa.array(i)), sums.take(pa.array(j)), pa.array(like)], ["left", "right", "jaccard"])

    return by_key(rows, "lead", pairs, "left string, right string, jaccard double", "checksum", least=ROWS).dropDuplicates(["left", "right"])


def nearest(store: DataFrame, p: SearchParams) -> DataFrame:
    """(checksum, rank, neighbour, jaccard): each stored snippet's top_n others by Jaccard."""
    pairs = once(similar_pairs(store, p))
    both = pairs.select(F.col("left").alias("query_id"), F.col("right").alias("checksum"), "jaccard").union(pairs.select("right", "left", "jaccard"))
    return _rank(both, F.col("jaccard"), p.top_n).select(F.col("query_id").alias("checksum"), "rank", F.col("checksum").alias("neighbour"), "jaccard")


def compare(pairs: DataFrame, store: DataFrame, p: SearchParams, graphs: bool = True) -> DataFrame:
    """Of each pair (left, right) of checksums: jaccard, edit_ratio, score, distinct and shared tokens, and the flow graphs' similarity."""
    own = store.select("checksum", "code", "sig")
    side = lambda s: own.select(F.col("checksum").alias(s), F.col("code").alias(f"code_{s}"), F.col("sig").alias(f"sig_{s}"))
    df = pairs.select("left", "right").join(side("left"), "left").join(side("right"), "right")
    toks = lambda s: F.array_distinct(text.tokens(F.col(f"code_{s}"), p.tokenizer))
    df = df.withColumns({"t_l": toks("left"), "t_r": toks("right"), "jaccard": jaccard(F.col("sig_left"), F.col("sig_right")), "edit_ratio": edit.edit_ratio("code_left", "code_right")})
    out = [F.col("left"), F.col("right"), F.col("jaccard"), F.col("edit_ratio"), edit.hybrid(F.col("jaccard"), F.col("edit_ratio"), p.jaccard_weight).alias("score"), F.size("t_l").alias("tokens_left"), F.size("t_r").alias("tokens_right"), F.size(F.array_intersect("t_l", "t_r")).alias("shared_tokens")]
    if graphs:
        df = df.withColumns({"g_l": cfg.cfg_extract("code_left"), "g_r": cfg.cfg_extract("code_right")})
        out.append(cfg.cfg_similarity(F.col("g_l"), F.col("g_r")).alias("cfg_similarity"))
    return df.select(*out)


#: Members of a class that are compared as one page.
PAGE = 128


def compare_alike(store: DataFrame, p: SearchParams, least: float = 0.0) -> DataFrame:
    """(left, right, jaccard, edit_ratio, score, cfg_similarity) of all stored pairs that share a bucket, of at least the given similarity: what compare() says of similar_pairs().

    Snippets of one signature are a class. Buckets and Jaccard are those of classes; their members meet page by page, so that a text moves once for each page that its own meets and not for
    each pair, and a task holds two pages. The pairs themselves are as many as they are.
    """
    valid = F.col("sig").isNotNull() & (F.size("sig") == p.num_perm) & has_elements(F.col("sig"))
    own = store.select("checksum", "code", "sig").where(valid).withColumn("class", F.min("checksum").over(Window.partitionBy("sig")))
    own = own.withColumn("page", F.floor((F.row_number().over(Window.partitionBy("class").orderBy("checksum")) - 1) / PAGE).cast("int"))
    own = once(own.withColumn("sig", F.when(F.col("checksum") == F.col("class"), F.col("sig"))))
    first = own.where("checksum = class").select("checksum", "sig")
    classes = similar_pairs(first, p, least).union(first.where(F.lit(least <= 1)).select("checksum", "checksum", F.lit(1.0)))
    pages = own.groupBy("class").agg(F.max("page").alias("last"))
    side = lambda c: pages.select(F.col("class").alias(c), F.explode(F.sequence(F.lit(0), "last")).alias(f"page_{c}"))
    met = classes.join(side("left"), "left").join(side("right"), "right").where("left < right or page_left <= page_right")
    met = once(met.withColumn("unit", F.monotonically_increasing_id()))
    rows = [met.select("unit", F.lit(k).alias("side"), F.col(c).alias("class"), F.col(f"page_{c}").alias("page"), "jaccard", F.expr("left = right and page_left = page_right").alias("same")) for k, c in enumerate(("left", "right"))]
    asked = rows[0].union(rows[1].where("not same"))  # a page that meets itself comes once
    rows = asked.join(own.select("class", "page", "checksum", "code"), ["class", "page"]).select("unit", "side", "jaccard", "checksum", "code")
    share = p.jaccard_weight

    def compared(unit: pa.Table) -> Iterator[pa.RecordBatch]:
        k = int(pc.sum(pc.equal(unit["side"], 0)).as_py())
        keys, codes = unit["checksum"].combine_chunks(), unit["code"].to_pylist()
        half = [np.arange(k), np.arange(k, len(codes)) if k < len(codes) else np.arange(k)]
        sums = np.array(keys.to_pylist(), object)
        x, y = ([codes[i] for i in h] for h in half)
        ratios = edit.ratio_table(x, y)
        shapes = [cfg.flow_graph(c)[:3] for c in codes]
        kinds = {s: n for n, s in enumerate(dict.fromkeys((a, b, tuple(c)) for a, b, c in shapes))}
        kind = np.array([kinds[a, b, tuple(c)] for a, b, c in shapes])
        table = np.array([[cfg.shape_similarity(g, h) for h in kinds] for g in kinds])
        i, j = np.indices(ratios.shape).reshape(2, -1)
        if k == len(codes):
            i, j = i[i < j], j[i < j]
        e = ratios[i, j]
        i, j = half[0][i], half[1][j]
        up = (sums[i] < sums[j]).astype(bool)
        jac = np.full(len(i), unit["jaccard"][0].as_py())
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.where(up, i, j))), keys.take(pa.array(np.where(up, j, i))), pa.array(jac), pa.array(e), pa.array(jac * (100.0 * share) + e * (1.0 - share)), pa.array(table[kind[i], kind[j]])], schema=_ALIKE)

    return by_key(rows, "unit", compared, "left string, right string, jaccard double, edit_ratio double, score double, cfg_similarity double", "side", "checksum")


_ALIKE = pa.schema([("left", pa.string()), ("right", pa.string()), *((n, pa.float64()) for n in ("jaccard", "edit_ratio", "score", "cfg_similarity"))])


def by_key(rows: DataFrame, key: str, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, *order: str, least: int = 1) -> DataFrame:
    """fn of the rows of each key as one table, or of several keys' together where they are fewer than `least` rows. A task holds no more than that and one batch of Arrow."""

    def each(batches):
        kept: list[pa.RecordBatch] = []
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                k = b.column(0).to_numpy(zero_copy_only=False)
                cuts = [*(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
                if kept and kept[-1].column(0)[-1].as_py() != k[0] and sum(x.num_rows for x in kept) >= least:
                    yield from fn(pa.Table.from_batches(kept))
                    kept = []
                at = 0
                for z in cuts[:-1]:
                    if sum(x.num_rows for x in kept) + z - at >= least:
                        yield from fn(pa.Table.from_batches([*kept, b.slice(at, z - at)]))
                        kept, at = [], z
                kept.append(b.slice(at))
            if kept:
                yield from fn(pa.Table.from_batches(kept))
        finally:
            give_back()

    return rows.select(key, *(c for c in rows.columns if c != key)).repartition(key).sortWithinPartitions(key, *order).mapInArrow(each, schema)


@F.udf(T.StringType())
def unified_diff(a, b):
    """A presentation aid for compared pairs; three lines of context."""
    import difflib

    return "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "left", "right", n=3, lineterm=""))
