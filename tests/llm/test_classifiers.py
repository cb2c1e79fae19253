import zlib

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import language, toxicity

BIG = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_language_cases(frame, spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9001, None, "en"), (9002, "", None), (9003, "12 34 !!", "de"), (9004, "THE THE of and that", None), (None, "the of and that with", "en"), (9004, "THE THE of and that", None)]
    both = docs.unionByName(frame(odd, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in language.identify(both).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (9001, 9002, 9003))
    assert out[9004].lang_pred == "en" and out[None].held_out is False
    blind = frame(odd[:4], "doc_id long, text string, lang string").withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(blind).collect()} == {"und"}
    assert language.identify(both.limit(0)).count() == 0
    kept = language.keep_identified(both.withColumn("score", F.lit("x")).withColumn("row", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "lang", "score", "row"]
    assert {r.doc_id for r in kept.collect()} >= {k for k, r in out.items() if r.score > 0.6} - {9001, 9002, 9003}


def test_weights_are_sparse_and_temperature_calibrates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs)
    assert all(0 < len(kept) < 0.5 * (1 << language.BITS) for kept in model.features)
    random = np.random.default_rng(0)
    truth = random.integers(0, 3, 4000)
    logits = np.log(np.where(np.arange(3) == truth[:, None], 0.8, 0.1))
    flipped = np.where(random.random(4000) < 0.2, random.integers(0, 3, 4000), truth)
    assert language.calibrate(3 * logits, flipped) > 2


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert all(r.predicted == int(r.score >= 0.7) for r in out)
    hits = sum(r.predicted and r.toxic for r in held)
    assert hits / max(1, sum(r.predicted for r in held)) >= 0.9 and hits / sum(r.toxic for r in held) >= 0.7


def test_toxicity_cases(frame, documents, texts):
    labels = frame([(k, k % 2) for k in range(0, 150)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = toxicity.score(documents, labels)
    assert out.count() == len(texts) and out.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    only = toxicity.score(documents, labels.filter("toxic = 0")).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in only] == [(0.0, 0)]
    assert toxicity.score(documents.limit(0), labels).count() == 0


def test_pairs_mean_more_than_their_sum():
    """Either of two terms alone is harmless, both together are not: no linear model can tell."""
    random = np.random.default_rng(3)
    rows = []
    for _ in range(1500):
        at = np.flatnonzero(random.random(6) < 0.5)
        rows.append((at, np.ones(len(at)), int(0 in at and 1 in at or not (0 in at or 1 in at))))
    bias, weights, factors = toxicity.learn(rows, 6)
    machine = toxicity.Machine(np.arange(6), bias, weights, factors)

    def p(at):
        v = machine.factors[at]
        raw = machine.bias + machine.weights[at].sum() + ((v.sum(axis=0) ** 2).sum() - (v * v).sum()) / 2
        return 1 / (1 + np.exp(-raw))

    assert p([0, 1]) > 0.7 and p([2]) > 0.7 and p([0, 2]) < 0.3 and p([1, 3]) < 0.3


def test_rare_toxic_terms_are_counted_in_all_labelled_rows(frame):
    ids = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 != 1][:500]
    rows = [(k, f"some words of number {k} " + ("awful " if n % 10 == 0 else "fine ") + ("zorgle" if n % 80 == 0 else "")) for n, k in enumerate(ids)]
    labels = frame([(k, int(n % 10 == 0)) for n, k in enumerate(ids)], "doc_id long, toxic int")
    machine = toxicity.train(frame(rows, "doc_id long, text string"), labels, most_sample=100)
    assert all(machine.kept[b] >= 0 for b in toxicity.terms(["zorgle"])[1][:1])


def test_a_doc_id_with_very_many_rows_does_not_fill_the_sample(frame):
    ids = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 != 1][:300]
    rows = [(k, f"number {k} says " + ("awful thing" if n % 3 == 0 else "fine thing")) for n, k in enumerate(ids)]
    rows += [(ids[1], f"row {j} of one id fine") for j in range(3000)]
    labels = frame([(k, int(n % 3 == 0)) for n, k in enumerate(ids)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(frame(rows, "doc_id long, text string"), labels, most_sample=200).collect()}
    assert min(out[k] for n, k in enumerate(ids) if n % 3 == 0) > 0.7 > 0.3 > max(out[k] for n, k in enumerate(ids) if n % 3)


def test_blocks_of_labels_make_no_difference(frame, documents):
    labels = frame([(k, k % 2) for k in range(150)] + [(3, 0)], "doc_id long, toxic int")
    one, many = (toxicity.train(documents, labels, block_labels=n) for n in (10_000, 40))
    assert (one.kept == many.kept).all() and one.bias == many.bias and (one.weights == many.weights).all() and (one.factors == many.factors).all()
    words = documents.selectExpr("cast(doc_id as string) doc_id", "text")
    named = toxicity.train(words, labels.selectExpr("cast(doc_id as string) doc_id", "toxic"))
    assert (named.kept == one.kept).all()


def test_scores_equal_a_plain_factorization_machine(spark, documents, texts, frame):
    """Terms one by one, every pair of terms, and counts by label, without arrays."""
    labels = [(k, k % 2) for k in range(150)]
    machine = toxicity.train(documents, frame(labels, "doc_id long, toxic int"))
    for _, text in texts[::40] + [(0, None), (0, "Awful AWFUL awfully x"), (0, "")]:
        buckets = toxicity.terms([text or ""])[1].tolist()
        found = {}
        for b in buckets:
            if machine.kept[b] >= 0:
                found[int(machine.kept[b])] = found.get(int(machine.kept[b]), 0) + 1
        value = {f: np.log2(1.0 + n) for f, n in found.items()}
        raw = machine.bias + sum(machine.weights[f] * v for f, v in value.items())
        names = sorted(value)
        for i, f in enumerate(names):
            for g in names[i + 1 :]:
                raw += float(machine.factors[f] @ machine.factors[g]) * value[f] * value[g]
        assert np.isclose(machine.scores([text or ""])[0], 1 / (1 + np.exp(-raw)))
    size = (1 << toxicity.BITS) + toxicity.LENGTHS
    there, totals = np.zeros((size, 2), int), np.zeros(2, int)
    known = {k: v for k, v in labels if zlib.crc32(str(k).encode()) % 3 != 1}
    for doc_id, text in texts:
        if doc_id in known:
            totals[known[doc_id]] += 1
            for b in set(toxicity.terms([text or ""])[1].tolist()):
                there[b, known[doc_id]] += 1
    assert (np.flatnonzero(machine.kept >= 0) == toxicity.telling(there, totals)).all()


def test_every_language_of_a_sorted_table_is_learned(frame):
    """Thirty languages of own letters, one after the other, and more of them than the sample could hold whole."""
    letters = [chr(0x4E00 + 40 * k + j) for k in range(30) for j in range(8)]
    random = np.random.default_rng(1)
    rows = [(60 * k + n, "".join(letters[8 * k + j] for j in random.integers(0, 8, 30)), f"l{k:02}") for k in range(30) for n in range(60)]
    model = language.train(frame(rows, "doc_id long, text string, lang string"), most_sample=600)
    out = language.predict(frame(rows, "doc_id long, text string, lang string").select("text", "lang"), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.99 and {r.lang_pred for r in out} == {f"l{k:02}" for k in range(30)}
    few = language.train(frame(rows + rows[:60], "doc_id long, text string, lang string"), most_languages=3)
    assert few.languages == ["l00", "l01", "l02"]


def test_a_language_of_equal_texts_is_learned(frame):
    rows = [(k, "the same english words every time", "en") for k in range(2000)]
    rows += [(5000 + k, f"les mots numéro {k} de la langue", "fr") for k in range(2000)]
    out = language.identify(frame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 5000 else "fr") for r in out)


def test_the_leader_equals_a_plain_version():
    """The update of every weight one by one, with the bias as a feature that is not penalised."""
    random = np.random.default_rng(2)
    rows = []
    for _ in range(30):
        at = np.sort(random.choice(12, 4, replace=False)) * 5000
        rows.append((at, random.random(4) * 9, int(random.integers(3))))
    weights, bias = language.follow_the_leader(rows, 3, seed=4)
    z, n = {}, {}

    def weight(f, c):
        a, b = z.get((f, c), 0.0), n.get((f, c), 0.0)
        l1 = 0.0 if f == "bias" else language.L1
        return 0.0 if abs(a) <= l1 else -np.sign(a) * (abs(a) - l1) / ((language.BETA + b**0.5) / language.ALPHA + language.L2)

    order = np.random.default_rng(4)
    for _ in range(language.EPOCHS):
        for k in order.permutation(len(rows)):
            x = {**dict(zip(rows[k][0].tolist(), rows[k][1].tolist(), strict=True)), "bias": 1.0}
            w = {(f, c): weight(f, c) for f in x for c in range(3)}
            score = [np.exp(sum(v * w[f, c] for f, v in x.items())) for c in range(3)]
            for f, v in x.items():
                for c in range(3):
                    g = v * (score[c] / sum(score) - (c == rows[k][2]))
                    b = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / language.ALPHA * w[f, c]
                    n[f, c] = b + g * g
    assert np.allclose(bias, [weight("bias", c) for c in range(3)])
    assert np.allclose(weights[::5000], [[weight(f, c) for c in range(3)] for f in range(0, 1 << language.BITS, 5000)])


def test_a_text_s_features_are_its_shares():
    """TF-IDF logits of texts, n-gram by n-gram."""
    texts = ["Ab  c!", "", "été", "a"]
    features, offsets, _ = language.ngrams(texts)
    weights = np.random.default_rng(0).normal(size=(1 << language.BITS, 2)) * (np.arange(1 << language.BITS) % 3 == 0)[:, None]
    logits = language.Model.of(["x", "y"], weights, np.array([0.1, 0.2])).logits(features, offsets)
    for k in range(len(texts)):
        own = features[offsets[k] : offsets[k + 1]].tolist()
        want = language.SCALE * sum(weights[f] for f in own) / max(1, len(own)) + np.array([0.1, 0.2]) if own else np.array([0.1, 0.2])
        assert np.allclose(logits[k], want)
    padded = " ab c "
    assert len(language.ngrams(["Ab  c"])[0]) == sum(len(padded) + 1 - n for n in (1, 2, 3))
