import random

from pyspark.sql import functions as F

from zonecast.llm import langid as L

ENGLISH = "the quick brown fox jumps over a lazy dog while some children watch from their window and laugh".split()
GERMAN = "der schnelle braune fuchs springt über den faulen hund während einige kinder aus ihrem fenster zusehen und lachen".split()
FRENCH = "le rapide renard brun saute par dessus un chien paresseux pendant que des enfants regardent depuis leur fenêtre".split()
LANGS = {"de": GERMAN, "en": ENGLISH, "fr": FRENCH}


def table(spark, n=240):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        rows.append((i, " ".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(6, 60))).capitalize() + ".", lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_rejection(spark):
    docs = table(spark)
    model = L.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    rows = L.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", L.held_out()).collect()
    held = [r for r in rows if r.held]
    assert 50 < len(held) < 110 and all(r.lang_pred == r.lang and r.accepted and 0 <= r.score <= 1 for r in held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (4, "zzxqv kqxj wqzx vvkq xjqz zqxw kkvx " * 5), (5, "日本語 " * 30), (6, "The LAZY dog!!"), (6, "The LAZY dog!!"),
                                 (7, "watch the fox " * 20_000), (8, "a\0b 😀 𐐀"), (None, "der hund")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and not any(got[i].accepted for i in (1, 2, 3, 4, 5))
    assert got[6].lang_pred == got[7].lang_pred == "en" and got[7].accepted and got[None].lang_pred == "de"
    kept = L.accept(odd.withColumn("score", F.lit("clash")), model)
    assert kept.columns == ["doc_id", "text", "score"] and sorted(r.doc_id for r in kept.where("doc_id IN (1, 2, 3, 4, 6)").collect()) == [6, 6]


def test_texts_beyond_one_piece_are_filtered_alike(spark, monkeypatch):
    docs = table(spark)
    model = L.fit(docs)
    whole = {r.doc_id for r in L.accept(docs, model).collect()}
    monkeypatch.setattr(L, "BATCH_BYTES", 300)
    assert {r.doc_id for r in L.accept(docs, model).collect()} == whole and len(whole) > 200


def test_labels_and_held_out_texts_are_not_read(spark):
    docs = table(spark)
    changed = docs.withColumn("lang", F.when(L.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn(
        "text", F.when(L.held_out(), F.concat("text", F.lit(" quark"))).otherwise(F.col("text")))
    a, b = L.fit(docs), L.fit(changed)
    assert a.languages == b.languages and all((a.probs[k] == b.probs[k]).all() for k in a.probs)


def test_probabilities_sum_to_one(spark):
    import numpy as np

    model = L.fit(table(spark, 60))
    keys, _, _ = L.grams(["the fox"])
    letters = np.arange(1 << 16, dtype=np.uint64)
    for key in keys[:4]:
        p = model.lookup(4, np.sort((key & ~np.uint64(0xFFFF)) | letters))
        assert np.allclose(p.sum(axis=1), 1)


def test_nothing_to_learn_from(spark, no_docs):
    model = L.fit(no_docs)
    assert L.predict(no_docs, model).collect() == []
    docs = spark.createDataFrame([(0, "text", None)], "doc_id long, text string, lang string")
    r = L.predict(docs, L.fit(docs)).first()
    assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)


def test_bounds_keep_the_most_frequent(spark):
    model = L.fit(table(spark), max_languages=2, max_ngrams=200)
    assert len(model.languages) == 2 and len(model.keys[4]) <= 200


def test_letters_beyond_the_basic_plane_are_told_apart_one_by_one(spark):
    texts = ["𐌰𐌱𐌲 𐌰𐌱", "😀 😀", "𠀀𠀁", "the fox 😀 laughs", "￿", "𝐀𝐁", "􏿿"]
    alone = [tuple(x.tolist() for x in (L.grams([t])[0], L.grams([t])[2])) for t in texts]
    assert [letters for _, letters in alone] == [[5], [0], [2], [12], [0], [2], [0]]
    keys, doc, letters = L.grams(texts)
    assert [(keys[doc == i].tolist(), [int(letters[i])]) for i in range(len(texts))] == alone
    model = L.fit(table(spark))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    together = sorted(L.predict(docs.coalesce(1), model).collect())
    assert together == sorted(r for i in range(len(texts)) for r in L.predict(docs.where(f"doc_id = {i}"), model).collect())
    assert [r.lang_pred == "und" for r in together] == [False, True, False, False, True, False, True]


def plain_entropy(grams, text, order=4):
    """Nats for each character by a plain interpolated Kneser-Ney, from one language's 4-grams with their counts."""
    from collections import Counter
    from math import log

    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(g):
        if not g:
            return 1 / (1 << 16)
        level = levels[len(g)]
        ones, twos = (sum(n == x for n in level.values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        beside = [n for x, n in level.items() if x[:-1] == g[:-1]]
        if not beside:
            return p(g[1:])
        return max(level.get(g, 0) - d, 0) / sum(beside) + d * len(beside) / sum(beside) * p(g[1:])

    own = unpacked(text)
    return sum(-log(p(g)) for g in own) / len(own)


def unpacked(text):
    return [tuple(k >> s & 0xFFFF for s in (48, 32, 16, 0)) for k in L.grams([text])[0].tolist()]


def test_every_label_and_ngram_is_learned(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(8)
    rows, labels = [], 230  # labels share their letters, so only n-grams tell them apart; later labels have fewer documents
    for k in range(labels):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(40)]
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(30)), f"l{k:03}") for i in range(14 if k < 200 else 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert len(model.languages) == labels
    sample = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    learned = {}
    for r in docs.where(~L.held_out() & ~sample).collect():
        learned.setdefault(r.lang, Counter()).update(unpacked(r.text))
    assert sum(map(len, learned.values())) == len(model.probs[4])
    got = L.predict(docs, model).join(docs.select("doc_id", "lang", "text"), "doc_id").where(L.held_out()).collect()
    right = sum(r.lang_pred == r.lang for r in got)
    print(f"held out, {labels} labels: {right} of {len(got)}, 4-grams {len(model.keys[4])}")
    assert right >= 0.99 * len(got)
    for r in got[:3] + [r for r in got if r.lang >= "l200"][:3]:
        assert abs(plain_entropy(learned[r.lang_pred], r.text) - r.entropy) < 1e-9
    whole = model.entropies([r.text for r in got[:20]])[0]
    monkeypatch.setattr(L, "CELLS", 1)
    assert (model.entropies([r.text for r in got[:20]])[0] == whole).all()


def test_a_stored_model_predicts_the_same(spark, monkeypatch):
    docs = table(spark).unionByName(spark.createDataFrame(
        [(1000 + i, "日本語の文章 " * (i + 3) + "鿿﨑 ￿ 힣", "ja") for i in range(24)], "doc_id long, text string, lang string"))  # keys beyond 2^63 too
    gathered = L.fit(docs)
    monkeypatch.setattr(L, "FILE_ENTRIES", 300)
    stored = L.fit(docs, broadcast_entries=10)
    assert isinstance(stored, L.StoredModel) and not isinstance(gathered, L.StoredModel) and not stored.keys
    assert len(stored.files["share", 4]) > 3 and stored.languages == gathered.languages == ["de", "en", "fr", "ja"]
    assert sorted(L.predict(docs, stored).collect()) == sorted(L.predict(docs, gathered).collect())
    assert (stored.limit, stored.limits) == (gathered.limit, gathered.limits)
    stored.open()
    for k in range(1, 5):
        for name in ("keys", "key_rows", "key_langs", "probs", "contexts", "context_rows", "context_langs", "weights"):
            assert (getattr(stored, name)[k] == getattr(gathered, name)[k]).all()
    kept = {r.doc_id for r in L.accept(docs, stored).collect()}
    assert kept == {r.doc_id for r in L.accept(docs, gathered).collect()} and len(kept) > 200


def test_predictions_and_limits_come_from_every_labelled_row(spark):
    from collections import Counter

    ids = spark.range(3000).select(F.col("id").alias("doc_id"))
    rare = ids.where(~L.held_out() & (F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0) & (F.col("doc_id") >= 240)).limit(2).collect()
    said = "egy gyors barna róka átugrik a lusta kutya felett miközben néhány gyerek az ablakból nézi és nevet "
    docs = table(spark, 90).unionByName(spark.createDataFrame([(r.doc_id, said * 3, "hu") for r in rare], "doc_id long, text string, lang string"))
    labelled = docs.where(~L.held_out()).withColumn("part", L.part()).collect()
    assert {r.part for r in labelled} == set(range(L.PARTS)) and {r.part for r in labelled if r.lang == "hu"} == {0}

    def learned(rows):
        out = {}
        for r in rows:
            out.setdefault(r.lang, Counter()).update(unpacked(r.text))
        return out

    def costs(counts, text):
        return {x: plain_entropy(c, text) for x, c in counts.items()}

    model = L.fit(docs)
    new = spark.createDataFrame([(-1, said), (-2, "the fox laughs"), (-3, "der hund lacht")], "doc_id long, text string")
    whole = learned(labelled)
    got = {r.doc_id: r for r in L.predict(new, model).collect()}
    for r in new.collect():
        want = costs(whole, r.text)
        assert got[r.doc_id].lang_pred == min(want, key=want.get) and abs(got[r.doc_id].whole_entropy - min(want.values())) < 1e-9
    assert got[-1].lang_pred == "hu" and got[-1].entropy == got[-1].whole_entropy and got[-2].entropy != got[-2].whole_entropy
    assert got[-1].accepted and -1 in {r.doc_id for r in L.accept(new, model).collect()}

    # each row judged by what the other parts learned
    worst = {}
    for p in range(L.PARTS):
        others = learned(r for r in labelled if r.part != p)
        for r in labelled:
            if r.part == p:
                found = costs(others, r.text)
                if min(found, key=found.get) == r.lang:
                    letters = int(L.grams([r.text])[2][0])
                    worst.setdefault((r.lang, letters.bit_length()), []).append(found[r.lang])
    assert sum(map(len, worst.values())) > 0.95 * len(labelled)
    assert {(model.whole.languages[x], size): round(limit, 9) for (x, size), limit in model.limits.items()} == {
        x: round(1.5 * max(own), 9) for x, own in worst.items()}
    assert abs(model.limit - 1.5 * max(max(own) for own in worst.values())) < 1e-9
