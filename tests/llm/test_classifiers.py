import math
import random

import numpy as np
from pyspark.sql import functions as F

from fotoloom.llm import language_id, quality_classifier, quality_rules, toxicity
from fotoloom.llm.textstats import COUNTS, counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and to is in that it was for on are with as be".split(), "de": "der die und ist von zu das mit ein für auf nicht als über".split(), "fr": "le la les de et un une que des est pour dans sur avec où".split()}
AWFUL = ["idiot", "moron", "scum", "trash"]


def corpus(n=400, seed=3):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = r.choice(list(WORDS))
        words = ["".join(r.choice(WORDS[lang]) for _ in range(r.randint(1, 2))) for _ in range(r.randint(60, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(AWFUL)
        junk = i % 4 == 1
        if junk:
            words = [w.upper() + "!!" for w in words] if i % 8 == 1 else [w + r.choice(["$$$", "###", "|"]) for w in words]
        docs.append((i, " ".join(words) + ".", lang, "s", 0))
        if i % 3:
            labels.append((i, 0 if junk else 1, int(toxic)))
    return docs, labels


EDGES = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, " \n ", "en", "s", 3), (None, "some words here", "en", "s", 1), (9003, "x" * 200_000, "en", "s", 1), (9004, "!!! 123", None, "s", 7), (3, None, "en", "s", 0)]


def slow_counts(text):
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    lines, seen, dup = 0, [], 0
    for line in text.split("\n"):
        if line.split():
            dup += line in seen
            seen.append(line)
            lines += 1
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, dup, len(hit)


def test_counts_by_brute_force():
    r = random.Random(1)
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    for _ in range(200):
        text = "".join(r.choice(["a ", "b ", "ü ", "c\n", "\n", "#", "x|y ", "a b c "]) for _ in range(r.randint(0, 60)))
        got = dict(zip(COUNTS, counts(text.encode())))
        assert tuple(got[n] for n in names) == slow_counts(text)
    for text in ["", " ", "\n\n", "a", "a b", "a a a"]:
        got = dict(zip(COUNTS, counts(text.encode())))
        assert tuple(got[n] for n in names) == slow_counts(text)


def test_quality_rules_separate_junk(spark):
    docs, _ = corpus()
    rows = {r["doc_id"]: r for r in quality_rules.rated(spark.createDataFrame(docs + EDGES, DOCS)).collect()}
    assert all(rows[d[0]]["good"] == (d[0] % 4 != 1) for d in docs if d[0] != 3)
    assert quality_rules.rated(spark.createDataFrame([], DOCS)).count() == 0
    assert sum(1 for _ in rows) == len(docs) + len(EDGES) - 1


def test_em_finds_accuracies():
    model = quality_rules.fit([])
    assert 0.8 < model["good"] < 1
    names = list(quality_rules.rules())
    junk = tuple(int(n in ("v_symbols", "v_symbol_chars")) for n in names)
    fine = tuple(int(n in ("v_sentences", "v_plain", "v_no_repeats")) for n in names)
    model = quality_rules.fit([(junk, 10), (fine, 90)])
    assert abs(model["good"] - 0.9) < 0.02
    assert quality_rules.posterior(junk, model) < 0.1 and quality_rules.posterior(fine, model) > 0.9


def test_quality_classifier_on_held_out_rows(spark):
    docs, labels = corpus()
    table, label = spark.createDataFrame(docs + EDGES, DOCS), spark.createDataFrame(labels + [(1, 0, 0), (None, 1, 0), (77777, None, None)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.scored(table, label).collect()
    assert len(rows) == len(docs) + len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    right = [r["predicted"] == int(r["doc_id"] % 4 != 1) for r in rows if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"] and r["doc_id"] != 3]
    assert sum(right) / len(right) > 0.97
    kept = quality_classifier.accepted(table.withColumn("row", F.lit(1)).withColumn("score", F.lit("x")), label)
    assert kept.columns == [*table.columns, "row", "score"] and 250 < kept.count() < 330


def test_no_labels(spark):
    docs, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(docs, DOCS)
    assert {r["score"] for r in quality_classifier.scored(table, none).collect()} == {0.5}
    assert toxicity.probabilities(table, none).where("toxic").count() == 0
    assert quality_classifier.scored(spark.createDataFrame([], DOCS), none).count() == 0


def test_rules_run_as_columns_like_in_training(spark):
    docs, labels = corpus(200)
    table, label = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(table, label)
    assert 0 < len(model.rules) < 200 and all(len(r) <= quality_classifier.DEPTH for r, _ in model.rules)
    counted = quality_classifier._score(quality_classifier.text_counts(table), model).collect()
    assert len(counted) == len(docs)
    for row in counted:
        total = model.bias
        for rule, weight in model.rules:
            total += weight * all((row[name] > limit) == above for name, above, limit in rule)
        assert abs(row["score"] - 1 / (1 + math.exp(-total))) < 1e-9


def test_toxicity_on_unlabelled_rows(spark):
    docs, labels = corpus()
    found = toxicity.probabilities(spark.createDataFrame(docs + EDGES, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(docs) + len(EDGES)
    new = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 3 == 0 and r["doc_id"] != 3]
    assert sum(r["toxic"] == (r["doc_id"] % 5 == 0) for r in new) / len(new) > 0.97
    assert not any(r["toxic"] for r in found if r["doc_id"] is None or r["doc_id"] >= 9000)


def test_language_on_held_out_rows(spark):
    docs, _ = corpus()
    rows = language_id.identified(spark.createDataFrame(docs + EDGES, DOCS)).collect()
    by = {d[0]: d[2] for d in docs}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in by and r["doc_id"] != 3]
    assert sum(r["lang_pred"] == by[r["doc_id"]] for r in held) / len(held) > 0.98
    odd = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] >= 9000}
    assert all(odd[d]["lang_pred"] == "und" and odd[d]["score"] == 0 for d in (9000, 9001, 9002, 9004)) and odd[9003]["lang_pred"] in WORDS
    assert len(rows) == len(docs) + len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_with_nothing_or_one_to_learn(spark):
    assert {r["lang_pred"] for r in language_id.identified(spark.createDataFrame([(1, "abc", None, "s", 1)], DOCS)).collect()} == {"und"}
    one = spark.createDataFrame([(k, "ab cd", "en", "s", 1) for k in range(10)], DOCS)
    assert {r["lang_pred"] for r in language_id.identified(one).collect()} == {"en"}
    assert language_id.identified(spark.createDataFrame([], DOCS)).count() == 0


def test_codewords_differ():
    for k in (2, 3, 4, 7, 12):
        code = language_id.codewords(k)
        assert len({tuple(w) for w in code.tolist()}) == k


def test_chain_scores_by_plain_sums(spark):
    docs, labels = corpus()
    table, label = spark.createDataFrame(docs + EDGES, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(table, label)
    marks = list(chain.marks)
    got = [(r["p_poor"], r["p_toxic"]) for r in spark.createDataFrame(docs, DOCS).select("doc_id", F.col("text").cast("binary")).mapInArrow(chain, "doc_id long, p_poor double, p_toxic double").orderBy("doc_id").collect()]
    for (_, text, *_), p in zip(docs[::7], got[::7]):
        own = "".join((c.lower() if c.isascii() else c) if c.isalpha() or ord(c) > 127 else " " for c in text).split()
        forms = [[m.decode(errors="replace") for m in toxicity.parts(w.encode())] for w in own]
        n = [sum(m.decode(errors="replace") in f for f in forms) for m in marks]
        x = [float(k > 0) for k in n] + [math.log1p(200 * k / max(1, len(own))) for k in n]
        x += [math.log1p(sum(k > 0 for k in n)), math.log1p(50 * sum(n) / max(1, len(own)))]
        earlier = []
        for model in chain.models:
            z = sum(a * float(b) for a, b in zip([*x, *(math.log(min(max(q, 1e-4), 1 - 1e-4) / (1 - min(max(q, 1e-4), 1 - 1e-4))) / 3 for q in earlier)], model.w)) + model.b
            earlier.append(1 / (1 + math.exp(-min(30, max(-30, z)))))
        assert all(abs(a - b) < 1e-3 for a, b in zip(earlier, p))


def test_out_of_fold_inputs_do_not_know_the_own_label():
    """With labels that nothing predicts, the second model gets nothing from the first one."""
    r = np.random.default_rng(5)
    x = (r.random((400, 300)) < 0.05).astype(np.float32)
    y = (r.random(400) < 0.5).astype(np.float32)
    models = toxicity.fit_chain(lambda _: x, [y, y], np.arange(400) % toxicity.FOLDS, [np.ones(400, bool)] * 2)
    assert models[1].w[-1] < 0.5  # in-fold probabilities would give a large weight


def test_toxicity_of_empty_tables_and_repeats(spark):
    docs, labels = corpus(120)
    none, label = spark.createDataFrame([], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.probabilities(none, label).count() == 0
    table = spark.createDataFrame(docs + docs[:10] + [(9900, "idiot " * 400_000, "en", "s", 0)], DOCS)
    rows = toxicity.probabilities(table.withColumn("p_toxic", F.lit("x")), label).collect()
    assert len(rows) == 131 and len({(r["doc_id"], round(r["p_toxic"], 6)) for r in rows}) == 121
    assert not toxicity.probabilities(table, label.where("toxic = 0")).where("toxic").count()


def test_codewords_are_decoded_by_weighted_loss():
    languages = ["a"] * 6 + ["b"] * 6 + ["c"] * 6 + ["d"] * 6
    texts = [word * (k + 2) for word in ("la le ", "der die ", "the of ", "och det ") for k in range(6)]
    x = np.stack([language_id.shares(t) for t in texts])
    model = language_id.fit_codes(x, languages)
    best, score, ahead = model.decide(x)
    for k, row in enumerate(x):
        z = [float(row @ model.weights[:, j] + model.bias[j]) for j in range(model.code.shape[1])]
        losses = [sum(t * math.log1p(math.exp(-bit * v)) for bit, v, t in zip(word, z, model.trust, strict=True)) for word in model.code.tolist()]
        shares = sorted((math.exp(min(losses) - loss) / sum(math.exp(min(losses) - other) for other in losses) for loss in losses), reverse=True)
        assert best[k] == losses.index(min(losses)) and model.languages[best[k]] == languages[k]
        assert abs(score[k] - shares[0]) < 1e-4 and abs(ahead[k] - (shares[0] - shares[1])) < 1e-4


def test_equal_losses_take_the_first_language_and_are_ambiguous():
    model = language_id.LanguageModel(["a", "b"], language_id.codewords(2), np.zeros((language_id.DIMENSIONS, 1), np.float32), np.zeros(1, np.float32), np.ones(1))
    best, score, ahead = model.decide(np.zeros((1, language_id.DIMENSIONS), np.float32))
    assert (best[0], score[0], ahead[0]) == (0, 0.5, 0) and ahead[0] < language_id.AMBIGUOUS


def test_language_sample_is_bounded_when_one_id_repeats(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE", 40)
    seen = []
    fit_codes = language_id.fit_codes
    monkeypatch.setattr(language_id, "fit_codes", lambda x, names: seen.append(len(names)) or fit_codes(x, names))
    docs = [(1, f"the of and {k}", "en", "s", 1) for k in range(300)] + [(2 + k, "der die und", "de", "s", 1) for k in range(30)]
    assert language_id.fit(spark.createDataFrame(docs, DOCS)) is not None and seen[0] <= 40
