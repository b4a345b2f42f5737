import random
import zlib

from pyspark.sql import functions as F

from zonecast.llm import sharding as S


def placed(docs, shards=16):
    return S.shard_by_links(S.measured(docs), "text_group", shards)


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_copies_stay_together_and_counts_are_even(docs_of):
    rng = random.Random(1)
    texts = [f"text {i}" for i in range(500)] + [f"copy {rng.randint(0, 60)}" for _ in range(300)] + [None, "", None]
    out = placed(docs_of(texts).repartition(5))
    rows = out.collect()
    check(rows, 16)
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    cut = S.cut_links(out, "text_group").first()
    assert cut.n_links > 500 and cut.n_cut == 0


def test_a_group_larger_than_a_shard_fills_whole_shards(docs_of):
    texts = ["hot"] * 400 + [f"t{i}" for i in range(700)] + ["warm"] * 100
    out = placed(docs_of(texts).repartition(4))
    rows = out.collect()
    check(rows, 16)
    of = {}
    for r in rows:
        of.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(of["hot"]) <= 7 and len(of["warm"]) <= 3  # 400 of 1200 rows need 6 of 16 shards, 100 need 2


def test_all_linked_and_all_in_one_group(docs_of):
    check(placed(docs_of([f"g{i % 20}" for i in range(203)])).collect(), 16)
    check(placed(docs_of(["same"] * 50)).collect(), 16)


def test_few_rows_repeated_rows_clashing_columns_and_none(docs_of, no_docs, spark):
    check(placed(docs_of([(1, "a"), (1, "a"), (2, "b")])).collect(), 16)
    rows = spark.createDataFrame([(1, None, "x", 5), (2, "g", "y", 6), (3, "g", "z", 7)], "k int, grp string, shard string, slot int")
    out = S.shard_by_links(rows, "grp", 2)
    check(out.collect(), 2)
    assert out.columns == ["k", "grp", "shard", "slot"]
    assert placed(no_docs).collect() == [] and S.cut_links(placed(no_docs), "text_group").first().n_links == 0


def test_quotas_never_exceed_wants_or_room():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(2, 5)
        wants = {(i, j): rng.randint(0, 9) for i in range(n) for j in range(n) if i != j}
        room = [rng.randint(0, 6) for _ in range(n)]
        allowed = S.quotas(wants, room)
        assert all(0 <= allowed[p] <= wants[p] for p in wants)
        for j in range(n):
            came = sum(v for (_, b), v in allowed.items() if b == j)
            left = sum(v for (a, _), v in allowed.items() if a == j)
            assert came - left <= room[j] or came - left <= 0 or came <= room[j] + sum(min(wants[i, j], wants[j, i]) for i in range(n) if i != j)


def test_numbers_are_gapless(spark):
    df = spark.range(5000).select(F.col("id").alias("_uid"), (F.col("id") % 3).alias("k"))
    got = {}
    for r in S.numbered(df, ["k"]).collect():
        got.setdefault(r.k, []).append(r["_rank"])
    assert all(sorted(x) == list(range(len(x))) for x in got.values())
