import pytest
from pyspark.sql import functions as F

from simlake.operators import search, store
from simlake.params import SearchParams
from simlake.sources import export, files
from simlake.streaming import ingest

P = SearchParams(threshold=0.5)
LOOP = "start:\n  lodsb\n  stosb\n  test al, al\n  jnz start\n  add ecx, 1\n  cmp ecx, 10\n  jb start\n  ret"


def make(spark, rows):
    df = spark.createDataFrame([(i, n, c, t, g) for i, (n, c, t, g) in enumerate(rows)], "ord int, name string, code string, tag string, collection string")
    return store.add_batch(store.empty(spark), df, P)


@pytest.fixture(scope="module")
def small(spark):
    return make(spark, [("a", LOOP, "x", "g"), ("b", LOOP + " ; note", "y", None), ("c", "push ebp\nmov ebp, esp\ncpuid\nxor eax, eax\nret", None, "h"), ("", "  ", None, None)]).cache()


def test_import_groups_and_aliases(spark, small):
    got = sorted((tuple(r.names), tuple(r.tags), r.collection) for r in small.collect())
    assert got == [(("a", "b"), ("x", "y"), "g"), (("c",), (), "h")]
    more = spark.createDataFrame([(0, "z", LOOP), (1, "a", LOOP), (2, "n", "nop\nret")], "ord int, name string, code string")
    again = store.add_batch(small, more, P)
    assert sorted(tuple(r.names) for r in again.collect()) == [("a", "b", "z"), ("c",), ("n",)]
    assert tuple(store.add_counts(small, more, P).first()) == (3, 1, 1, 1)


def test_find_is_brute_force_and_pruning_changes_nothing(spark):
    rows = [(f"s{i}", f"mov eax, {i}\n" + "\n".join(f"op{i % 5}{k} ebx, {k}" for k in range(i % 9 + 3)), None, None) for i in range(40)]
    s = make(spark, rows).cache()
    p = SearchParams(threshold=0.0, top_n=4)
    q = search.fingerprint(spark.createDataFrame([(0, rows[7][1]), (1, rows[20][1] + "\nnop"), (2, "zzz")], "query_id int, code string"), p)
    a, b = (sorted(map(tuple, (r[:3] for r in search.find(q, s, p, prune).select("query_id", "rank", "checksum").collect()))) for prune in (True, False))
    assert a == b
    cand = {(r.query_id, r.checksum) for r in search.candidates(q, s, p).collect()}
    assert len(cand) == sum(r.n_candidates for r in search.candidate_counts(q, s, p).collect())
    assert search.candidate_counts(q, s, p).where("query_id = 2").first().n_candidates == 0
    assert search.find(q, s, SearchParams(threshold=0.0, top_n=0)).count() == 0
    one = search.find(q.where("query_id = 0"), s, p).collect()
    assert sorted(r.checksum for r in one) == sorted(c for qid, _, c in a if qid == 0)
    assert one[0].rank == 1 and max(r.score for r in one) == 100.0


def test_renamed_label_is_found(spark, small):
    q = search.fingerprint(spark.createDataFrame([(0, LOOP.replace("start", "again"))], "query_id int, code string"), P)
    assert search.find(q, small, P).first().names == ["a", "b"]


def test_queries_on_one_line(spark):
    df = spark.createDataFrame([("PUSH EBP; RET",), ("a ; b\nc",)], "q string")
    assert [r[0] for r in df.select(search.separate_lines(F.col("q"))).collect()] == ["PUSH EBP\n RET", "a ; b\nc"]


def test_names_tags_collections(spark, small):
    a = small.where("array_contains(names, 'a')").first().checksum
    c = small.where("array_contains(names, 'c')").first().checksum
    ask = lambda rows, col: spark.createDataFrame(rows, f"checksum string, {col} string")
    s, out = store.name_add(small, ask([(a, "b"), (c, "new"), ("no", "x")], "name"))
    assert {r.checksum: r.status for r in out.collect()} == {a: "duplicate", c: "added", "no": "missing"}
    assert store.by_checksum(s, c).first().names == ["c", "new"]
    s, out = store.name_remove(small, ask([(a, "a"), (c, "c")], "name"))
    assert {r.checksum: r.status for r in out.collect()} == {a: "removed", c: "last"}
    assert store.by_checksum(s, a).first().names == ["b"]
    s = store.tag_add(small, ask([(a, " z "), (a, "x"), (c, " ")], "tag"))
    assert store.by_checksum(s, a).first().tags == ["x", "y", "z"] and store.by_checksum(s, c).first().tags == []
    assert store.by_checksum(store.tag_remove(s, ask([(a, "x")], "tag")), a).first().tags == ["y", "z"]
    cols = store.collection_create(store.empty(spark, store.COLLECTIONS), "g", "d")
    assert store.collection_create(cols, "g", "e").count() == 1
    assert {r.name: r.n_snippets for r in store.collection_counts(small, cols).collect()} == {"g": 1}
    s = store.collection_add(small, cols, spark.createDataFrame([(c, "g"), (a, "absent")], "checksum string, name string"))
    assert store.members(s, "g").count() == 2
    s, cols = store.collection_delete(s, cols, "g")
    assert s.where("collection is not null").count() == 0 and cols.count() == 0


def test_merge(spark, small):
    source = make(spark, [("a2", LOOP, "w", "other"), ("n", "nop\nret", None, "k")])
    m = {tuple(r.names): (tuple(r.tags), r.collection) for r in store.merge(small, source, P).collect()}
    assert m == {("a", "a2", "b"): (("w", "x", "y"), "g"), ("c",): ((), "h"), ("n",): ((), "k")}
    assert tuple(store.merge_counts(small, source).first()) == (2, 1, 1, 0)
    broken = source.withColumn("sig", F.lit(None).cast("array<bigint>"))
    assert store.merge(small, broken, P).where("sig is null").count() == 0


def test_lookup_paging_and_digest(spark, small):
    keys = sorted(r.checksum for r in small.collect())
    asked = spark.createDataFrame([(k,) for k in (keys[0], keys[0][:8], "zz", "")], "prefix string")
    got = {r.prefix: (r.status, r.checksum) for r in store.resolve_prefixes(small, asked).collect()}
    assert got[keys[0]] == got[keys[0][:8]][:1] + (keys[0],) and got["zz"] == ("missing", None)
    assert [r.checksum for r in store.page(small, 1, 2).collect()] == keys[1:2]
    assert store.page(small, 0, 0).count() == 2
    with pytest.raises(ValueError):
        store.page(small, 3, 1)
    assert store.state_digest(small).first()[0] == f"2-{keys[1]}"
    assert store.state_digest(store.empty(spark)).first()[0] == "empty"
    assert store.search_names(small, "A").count() == 1
    assert store.sample(small, 1, 3).collect() == store.sample(small.repartition(3), 1, 3).collect()


def test_stats_and_verify(spark, small):
    assert tuple(store.stats(store.empty(spark), P).first()) == (0, 0.0, 0)
    assert store.average_similarity(store.empty(spark), P).first()[0] == 0.0
    assert store.average_similarity(small.limit(1), P).first()[0] == 1.0
    index = search.band_index(small, P)
    assert store.verify(small, P, index, P.fingerprint_key).first().n_issues == 0
    assert store.verify(small, P, index.limit(3)).first().n_issues == 1
    assert store.verify(small, P, None, {"version": "0"}).first().n_warnings == 2
    assert store.index_add(index.limit(0), small, P).count() == index.count()
    assert store.index_remove(index, small.select("checksum")).count() == 0
    assert store.needs_reindex(None, P) and not store.needs_reindex(P.fingerprint_key, P)


def test_compare(spark, small):
    k = sorted(r.checksum for r in small.collect())
    pairs = spark.createDataFrame([(k[0], k[1]), (k[0], k[0])], "left string, right string")
    got = {(r.left, r.right): r for r in search.compare(pairs, small, P).collect()}
    same = got[k[0], k[0]]
    assert (same.jaccard, same.edit_ratio, same.score, same.cfg_similarity) == (1.0, 100.0, 100.0, 1.0)
    assert got[k[0], k[1]].jaccard < 0.5 and got[k[0], k[1]].shared_tokens >= 1


def test_directory_source_and_sinks(spark, small, tmp_path):
    d = tmp_path / "in" / "deep"
    d.mkdir(parents=True)
    (d / "one.asm").write_text(LOOP)
    (d / "two.TXT").write_text("nop")
    (d / "bad.asm").write_bytes(b"\xff\xfe\x00")
    (d / "none.asm").write_text(" \n")
    (d / "other.c").write_text("int x;")
    got = {r.name: (r.code, r.reject) for r in files.read_directory(spark, str(tmp_path / "in")).collect()}
    assert got == {"one": (LOOP, None), "two": ("nop", None), "bad": (None, "not UTF-8"), "none": (None, "empty")}
    odd = spark.createDataFrame([("f" * 64, ["../../etc/x"], "a\"b\\\n"), ("a" * 64, ["Con"], "c"), ("b" * 64, ["con"], "d"), ("c" * 64, [""], "e")], "checksum string, names array<string>, code string")
    names = [r.file_name for r in export.export_names(odd).collect()]
    assert len({n.lower() for n in names}) == 4 and not any("/" in n or n.startswith(".") for n in names)
    assert export.export_directory(odd, str(tmp_path / "out")) == 4
    assert len(list((tmp_path / "out").iterdir())) == 4
    rule = export.yara_rules(odd.where("code like 'a%'")).first().rule
    assert rule.startswith("rule simlake_______etc_x_")
    rule = export.yara_rules(odd.where("code like 'a%'").withColumn("names", F.array(F.lit("9 lives")))).first().rule
    assert '$text = "a\\"b\\\\\\n"' in rule and rule.startswith("rule simlake_r_")
    export.write_store(small, str(tmp_path / "store"))
    assert files.read_store(spark, str(tmp_path / "store")).count() == 2
    export.write_index(search.band_index(small, P), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index")).where("band = 0").count() == 2
    (tmp_path / "q.txt").write_text("mov eax, 1\n# no\n\nret\n")
    assert [r.code for r in files.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["mov eax, 1", "ret"]
    export.export_csv(small, str(tmp_path / "csv"))
    assert '"names"' in export.as_json(export.flat(small)).first().json


def test_config(tmp_path):
    c = files.Config.load(tmp_path / "none.toml")
    c = c.set("top_n", "9").set("format", "json")
    c.save(tmp_path / "c.toml")
    assert files.Config.load(tmp_path / "c.toml") == c
    assert c.unset("top_n").top_n == 5
    with pytest.raises(KeyError):
        c.set("nothing", "1")
    (tmp_path / "bad.toml").write_text("= 3")
    assert files.Config.load(tmp_path / "bad.toml") == files.Config()


def test_streaming_ingest_equals_batch(spark, tmp_path):
    rows = [(i, f"n{i}", f"mov eax, {i % 3}\nret\nnop\ncpuid" + "\ninc eax" * (i % 3)) for i in range(8)]
    schema = "ord int, name string, code string"
    for k in (0, 1):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.stream_documents(spark, str(tmp_path / "in"), schema)
    ingest.ingest(stream, str(tmp_path / "store"), str(tmp_path / "cp"), P).awaitTermination()
    got = {r.checksum for r in spark.read.parquet(str(tmp_path / "store" / "gen=1")).collect()}
    want = {r.checksum for r in store.add_batch(store.empty(spark), spark.createDataFrame(rows, schema), P).collect()}
    assert got == want


def test_repeated_requests_leave_one_row_each(spark, small):
    sums = [r.checksum for r in small.select("checksum").orderBy("checksum").collect()]
    n = small.count()
    asked = spark.createDataFrame([(sums[0], "b1"), (sums[0], "a1"), (sums[0], "b1"), ("none", "x")], "checksum string, name string")
    s, out = store.name_add(small, asked)
    assert s.count() == n and s.where(F.col("checksum") == sums[0]).first().names[-2:] == ["a1", "b1"]
    assert sorted(r.status for r in out.collect()) == ["added", "added", "missing"]
    every = s.where(F.col("checksum") == sums[0]).select("checksum", F.explode("names").alias("name"))
    s, out = store.name_remove(s, every.union(every))
    assert s.count() == n and len(s.where(F.col("checksum") == sums[0]).first().names) == 1
    assert sum(r.status == "last" for r in out.collect()) == 1
    boxes = spark.createDataFrame([("c1", "", None), ("c2", "", None)], "name string, description string, created_at timestamp")
    s = store.collection_add(small, boxes, spark.createDataFrame([(sums[0], "c2"), (sums[0], "c1"), (sums[0], "no")], "checksum string, name string"))
    assert s.count() == n and s.where(F.col("checksum") == sums[0]).first().collection == "c2"
    s = store.collection_remove(s, spark.createDataFrame([(sums[0],), (sums[0],)], "checksum string"))
    assert s.count() == n and s.where(F.col("checksum") == sums[0]).first().collection is None


def test_signatures_of_another_length_are_left_out(spark, small):
    odd = small.limit(1).withColumn("checksum", F.lit("f" * 64)).withColumn("sig", F.array(F.lit(1).cast("bigint")))
    assert store.average_similarity(small.union(odd), P).first() == store.average_similarity(small, P).first()


def test_comparison_uses_the_weight_it_is_given(spark, small):
    import dataclasses

    pair = small.agg(F.min("checksum").alias("left"), F.max("checksum").alias("right"))
    r = search.compare(pair, small, dataclasses.replace(P, jaccard_weight=1.0), graphs=False).first()
    assert abs(r.score - 100 * r.jaccard) < 1e-9


def test_reserved_stems_with_an_extension(spark):
    df = spark.createDataFrame([("a" * 64, ["con.x"]), ("b" * 64, ["console"])], "checksum string, names array<string>")
    assert sorted(r.file_name for r in export.export_names(df).collect()) == ["_con.x.asm", "console.asm"]
