import importlib
import random

import corpus_pipeline as C
from zonecast.llm import jaccard, langid, quality
from zonecast.llm.oracle import ORACLES
from zonecast.llm.queries import QUERIES


def corpus(spark):
    rng = random.Random(6)
    words = {"en": "the quick brown fox jumps over a lazy dog while children watch and laugh at it".split(),
             "de": "der schnelle braune fuchs springt über einen faulen hund während kinder zusehen und darüber lachen".split()}
    # many words, so that texts of one language aren't near duplicates
    for own in words.values():
        own += [a + b for a in own for b in own]
    rows = []
    for i in range(200):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(40, 200))) + ".", lang, "s", 0))
    text = rows[7][1]
    rows += [(300, text, "en", "s", 0), (301, text + " once more", "en", "s", 0), (302, None, "en", "s", 0), (303, "", None, "s", 0), (304, "!!! 123", "en", "s", 0),
             (305, "few words", "en", "s", 0), (306, "spam " * 100, "en", "s", 0), (307, rows[8][1] + " password=hunter22x", "en", "s", 0), (7, text, "en", "s", 0)]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s, _ in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_and_run(spark, tmp_path):
    docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in C.STAGES] == ["language", "quality", "duplicates", "secrets", "packing"]
    kept = {}
    at = docs
    for name, stage in C.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        at.write.parquet(str(tmp_path / f"out-{name}"))
        at = spark.read.parquet(str(tmp_path / f"out-{name}"))
        kept[name] = {r.doc_id: r for r in at.collect()}
    assert not {302, 303, 304} & set(kept["language"]) and set(range(200)) <= set(kept["language"])
    assert not {305, 306} & set(kept["quality"]) and set(range(200)) <= set(kept["quality"])
    assert not {300, 301, 307} & set(kept["duplicates"]) and set(range(200)) <= set(kept["duplicates"])
    assert at.count() == 200
    assert all("hunter22x" not in r.text and r.n_chars == len(r.text) for r in kept["secrets"].values())
    pieces = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(range(200))


def test_masking_takes_effect(spark):
    df = spark.createDataFrame([(1, "password=hunter22x", "en", "s", 18)], "doc_id long, text string, lang string, source string, n_chars long")
    assert C.mask_secrets(spark, df, "").first().text == "[assign removed]"


def test_empty_documents(spark, no_docs):
    at = no_docs
    for _, stage in C.STAGES:
        at = stage(spark, at, "")
    assert at.collect() == []


def test_every_operator_is_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) <= set(names) and "pipeline" not in entry.oracle_sql()
    assert all(m.__doc__ and "efined results for odd input" in m.__doc__ for m in (jaccard, langid, quality))


def test_checkpoints_have_a_few_files_a_core(spark):
    from zonecast.llm import batches

    many = 3 * batches.FILES_A_CORE * spark.sparkContext.defaultParallelism
    df = spark.range(1000).repartition(many)
    got = batches.written(df)
    assert got.rdd.getNumPartitions() == many // 3 and sorted(r.id for r in got.collect()) == list(range(1000))
