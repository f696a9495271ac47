"""Text statistics, decision list, rule ensemble and toxicity grammar."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.llm import decision_list, queries, rulefit, toxicity
from lamina.llm.text_stats import remainder, with_base_stats


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 5))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("frame", ["documents", "messy", "clashing"])
def test_statistics(request, frame):
    df = request.getfixturevalue(frame).select("text")
    for r in with_base_stats(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_stats(r.text or "")


def brute_rates(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup, repeat = brute_stats(text)
    count = lambda p: len(re.findall(p, text))
    per = lambda x, y: x / y if y else 0.0
    return {
        "n_words": n, "mean_word": per(chars, n), "symbol_rate": per(symbols, n), "upper_rate": per(count("[A-Z]"), chars), "mark_rate": per(count("[!?]"), n),
        "digit_rate": per(count("[0-9]"), chars), "distinct_rate": per(len(set(words)), n), "repeat_rate": per(repeat, n), "dup_line_rate": per(dup, len(lines)),
    }


def holds(rule, rates):
    return all(rates[t.stat] > t.limit if t.above else rates[t.stat] <= t.limit for t in rule)


@pytest.fixture(scope="module")
def some(spark):
    """The documents and labels of a larger table."""
    return tuple(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))


def test_decision_list_row_by_row_and_on_held_out_rows(some):
    documents, labels = some
    rules = decision_list.fit(documents, labels, where=remainder(F.col("doc_id"), 5) != 0)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    beyond = []
    for r in decision_list.apply_rules(documents, rules).collect():
        rates = brute_rates(r.text or "")
        failed = rates["n_words"] < 10 or rates["repeat_rate"] > 0.2
        rejected = any(holds(rule, rates) for rule in rules.rules)
        assert (r.base_failed, r.kept) == (failed, not failed and not rejected)
        if not failed and r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0:
            beyond.append((truth[r.doc_id], r.kept))
    bad, good = [kept for q, kept in beyond if q == 0], [kept for q, kept in beyond if q == 1]
    # beyond the base rule, bad documents go and good ones stay
    assert len(bad) >= 3 and bad.count(False) >= 0.7 * len(bad)
    assert good.count(True) >= 0.9 * len(good)


def test_rule_ensemble_row_by_row(some):
    documents, labels = some
    ensemble = rulefit.fit(documents, labels, where=remainder(F.col("doc_id"), 3) != 1)
    assert len(ensemble.rules) > 2
    for r in rulefit.apply_ensemble(documents, ensemble).collect():
        rates = brute_rates(r.text or "")
        total = ensemble.intercept + sum(w for rule, w in ensemble.rules if holds(rule, rates))
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_long_unbroken_runs_in_all_models(spark, labels, documents):
    size = 1_000_000
    texts = ["a" * size, "a/" * (size // 2), "idiot" * (size // 5), "you idiot " * (size // 10), "x " * (size // 2), "\n" * size, "!" * size]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules, ensemble, model = decision_list.fit(documents, labels), rulefit.fit(documents, labels), toxicity.fit(documents, labels)
    kept = {r.doc_id: r for r in decision_list.apply_rules(df, rules).select("doc_id", "n_words", "n_repeat_words", "kept").collect()}
    assert kept[4].n_words == kept[4].n_repeat_words == size // 2 and not any(r.kept for r in kept.values())
    assert rulefit.apply_ensemble(df, ensemble).where("score between 0 and 1").count() == len(texts)
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert scores[3] > 0.5 > scores[0]


def accuracy(rows, labels, name):
    truth = {r.doc_id: r[name] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held)


def test_rule_ensemble_on_held_out_rows(spark, sf, labels, documents):
    rows = queries.op9_rule_ensemble(spark, sf).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert accuracy(rows, labels, "quality") >= 0.9


def test_toxic_grammar_query(spark, sf, documents):
    rows = queries.op8_toxic_grammar(spark, sf).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.fixture(scope="module")
def toxic_model(spark):
    """As the query fits it, on the documents of a folder whose labels tell more than a few toxic ones."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, toxicity.fit(docs, labels, where=remainder(F.col("doc_id"), 5) != 0)


def test_toxic_documents_are_found_and_clean_ones_left(toxic_model):
    docs, labels, model = toxic_model
    scored = toxicity.score(docs, model).join(labels.where("toxic IS NOT NULL"), "doc_id").withColumn("held", remainder(F.col("doc_id"), 5) == 0)
    held = {r["toxic"]: (r["n"], r["flagged"]) for r in scored.where("held").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("predicted").alias("flagged")).collect()}
    assert held[0][1] == 0 and held[1][1] >= 4 and held[1][0] == 6
    everything = {r["toxic"]: r["share"] for r in scored.groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()}
    assert everything[0] == 0.0 and everything[1] >= 0.6


def test_scores_follow_the_grammar(spark, toxic_model):
    model = toxic_model[2]
    texts = ["I will kill you", "You are an idiot", "You stupid idiot", "I will kill the process", "You are not an idiot", "The stupid bug is gone", "He said you are an idiot", "I will never kill you", "We are going to shoot the movie", "", None]
    at = {r.text: r.score for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert all(at[t] >= 0.5 for t in texts[:3]) and all(at[t] < 0.5 for t in texts[3:])
    assert at["I will kill you"] > at["I will never kill you"] > at[""]
    assert at["You are an idiot"] > at["The stupid bug is gone"] > at["He said you are an idiot"] > at[""] == at[None]
    for name, (low, _, high) in toxicity.BOUNDS.items():
        assert low <= model.weights[name] <= high


@pytest.mark.parametrize("kind", ["any", "no threats", "one word decides", "few"])
def test_weights_keep_their_order_whatever_the_labels_say(kind):
    draw = np.random.default_rng(8)
    n = 12 if kind == "few" else 400
    x = draw.poisson(0.5, (n, 5)).astype(float) * 3.0
    y = draw.integers(0, 2, n).astype(float)
    if kind == "no threats":
        x[:, 4], y = 0.0, (x[:, 0] > 4).astype(float)
    if kind == "one word decides":
        x[:, 1:], y = 0.0, (x[:, 0] > 0).astype(float)
    w = toxicity.learn_weights(x, y)
    assert w["threat"] * 3.0 > w["level"] and toxicity.HEAVIEST + w["aimed"] > w["level"] > toxicity.HEAVIEST
    assert w["negated"] < w["reported"] + 0.3 < 1.0 and w["reported"] * (toxicity.HEAVIEST + 1.0) < w["level"]
    if kind == "no threats":
        assert w["threat"] == toxicity.BOUNDS["threat"][1]


def plain_score(model, text):
    """Every clause of a text through the five machines, one after another."""
    stages, sums = [make() for make in toxicity.MACHINES], dict.fromkeys(toxicity.FEATURES, 0.0)
    for clause in re.split("[.!?;:\n\r,()\\[\\]\"“”«»]", (text or "").lower()):
        states = [m.start for m in stages]
        words = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", clause)
        known = [model.lexicon.words.get(w) or next((model.lexicon.stems[w[:k]] for k in toxicity.STEMS if len(w) >= k and w[:k] in model.lexicon.stems), ("O", 0.0)) for w in words]
        for symbol, own in known:
            out, total = symbol, 0.0
            for k, m in enumerate(stages):
                states[k], out, weight = m.step(states[k], out)
                total += weight
            mark = out[0] in "IS" or "!" in out or out.endswith("+")
            own = own if symbol in ("I", "S") else 0.0
            if mark and "-" in out:
                sums["negated"] += total + own
            elif mark and "r" in out:
                sums["reported"] += total + own
            elif mark and "!" in out:
                sums["threat"] += total
            elif mark and "+" in out:
                sums["aimed"], sums["insult"] = sums["aimed"] + 1.0, sums["insult"] + own
            elif mark:
                sums["insult"] += total + own
    w, at = model.weights, {k: max(v, 0.0) for k, v in sums.items()}
    whole = at["insult"] + sum(w[k] * at[k] for k in ("aimed", "negated", "reported", "threat"))
    return 1 / (1 + np.exp(-w["slope"] * (np.log1p(whole) - np.log1p(w["level"]))))


def test_scores_are_those_of_every_clause_read_plainly(spark, toxic_model, messy):
    docs, _, model = toxic_model
    texts = ["You fool, he said: you idiot! Not an idiot; I will strangle them all. They kill you", "Idiot-moron (you) and the stupid's", "ich werde dich umbringen\nje vais te tuer", "DU ARSCHLOCH\x00du, trottel_x idiot3 Éidiot idiots"]
    made = messy.select("text").union(docs.select("text")).union(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in toxicity.score(made, model).collect():
        assert r.score == pytest.approx(plain_score(model, r.text), abs=1e-12), (r.text or "")[:80]


def test_decision_list_query(spark, sf, labels, documents):
    rows = {r.doc_id: r for r in queries.op10_decision_list(spark, sf).collect()}
    for d in documents.collect():
        r, want = rows[d.doc_id], brute_stats(d.text)
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    good = [r.doc_id for r in labels.where("quality = 1").collect() if not rows[r.doc_id].base_failed]
    assert sum(rows[i].kept for i in good) >= 0.97 * len(good)


def test_models_on_messy_clashing_and_empty_rows(spark, clashing, empty, labels):
    rules = decision_list.fit(clashing, labels)
    assert decision_list.apply_rules(clashing, rules).count() == 11 and decision_list.apply_rules(empty, rules).count() == 0
    ensemble = rulefit.fit(clashing, labels)
    assert rulefit.apply_ensemble(clashing, ensemble).where("score between 0 and 1").count() == 11
    model = toxicity.fit(clashing, labels)
    assert toxicity.score(clashing, model).where("score between 0 and 1").count() == 11
    assert toxicity.reject(clashing, model).columns == clashing.columns and toxicity.reject(empty, model).count() == 0
    none = labels.limit(0)
    assert str(decision_list.fit(clashing, none)).strip() == "else keep"
    assert rulefit.fit(empty, none).rules == []


def test_covering_finds_planted_thresholds():
    draw = np.random.default_rng(3)
    data = {"a": draw.random(900), "b": draw.random(900)}
    bad = ((data["a"] > 0.7) & (data["b"] <= 0.4)) | (data["b"] > 0.95)
    learned = decision_list.learn(data, bad)
    caught = np.zeros(900, bool)
    for rule in learned.rules:
        hit = np.ones(900, bool)
        for term in rule:
            hit &= term.holds(data[term.stat])
        caught |= hit
    assert (caught & bad).sum() >= 0.95 * bad.sum() and (caught & ~bad).sum() <= 3
    assert decision_list.learn(data, np.zeros(900, bool)).rules == []


def test_verdict_is_one_ordered_conditional(spark):
    term = decision_list.Term
    rules = decision_list.DecisionList([(term("a", True, 0.5), term("b", False, 1.0)), (term("b", True, 9.0),)])
    df = spark.createDataFrame([(0.6, 1.0), (0.6, 2.0), (0.0, 10.0), (None, None)], "a double, b double")
    assert [r.k for r in df.select(rules.verdict().alias("k")).collect()] == [False, True, False, True]


def test_tree_paths():
    text = "Tree 0 (weight 1.0):\n    If (feature 0 <= 1.5)\n     Predict: 0.0\n    Else (feature 0 > 1.5)\n     If (feature 1 <= -2.0E-4)\n      Predict: 1.0\n     Else (feature 1 > -2.0E-4)\n      Predict: 0.0"
    paths = rulefit.tree_paths(text, ("x", "y"))
    assert [" and ".join(map(str, p)) for p in paths] == ["x <= 1.5", "x > 1.5", "x > 1.5 and y <= -0.0002", "x > 1.5 and y > -0.0002"]


def marks(*symbols):
    machine, state, out = toxicity.grammar(), toxicity.grammar().start, []
    for s in symbols:
        state, o, _ = machine.step(state, s)
        out.append(o)
    return out


def test_grammar_marks_negation_target_and_report():
    assert marks("T", "O", "I") == ["T", "O", "I+"]
    assert marks("O", "I", "T", "O") == ["O", "I", "T+", "O"]
    assert marks("N", "O", "I") == ["N", "O", "I-"]
    assert marks("N", "O", "O", "O", "I")[-1] == "I"
    assert marks("R", "T", "I")[-1] == "Ir+"
    assert marks("T", "R", "N", "I")[-1] == "I-r+"


def test_a_threat_takes_an_intention_or_a_target():
    assert marks("F", "W", "H", "T") == ["F", "W", "H!", "T!"]
    assert marks("T", "H", "O", "O") == ["T", "H", "O", "O"]
    assert marks("H", "T") == ["H", "T!"] and marks("H", "O", "O", "O", "T")[-1] == "T"
    assert marks("R", "F", "W", "H", "T")[3:] == ["H!r", "T!r"] and marks("F", "W", "N", "H")[-1] == "H!-"
    reader = toxicity.Reader(toxicity.seed_lexicon())
    score = lambda text: dict(zip(toxicity.FEATURES, reader.features(text), strict=True))["threat"]
    assert score("You kill the process and restart it") == 0.0
    assert score("I will kill you") > score("kill you") > 0.0 == score("I will kill the process") == score("We are going to shoot the movie")


@given(st.lists(st.sampled_from(toxicity.SYMBOLS), max_size=12))
def test_the_composed_machine_is_the_five_one_after_another(symbols):
    stages = [make() for make in toxicity.MACHINES]
    states = [m.start for m in stages]
    machine, state = toxicity.grammar(), toxicity.grammar().start
    for symbol in symbols:
        out, total = symbol, 0.0
        for k, m in enumerate(stages):
            states[k], out, weight = m.step(states[k], out)
            total += weight
        state, mine, weight = machine.step(state, symbol)
        assert (mine, weight) == (out, total)


def test_clauses_are_scored_not_words():
    reader = toxicity.Reader(toxicity.Lexicon({"fool": ("I", 2.0), "you": ("T", 0.0), "not": ("N", 0.0), "said": ("R", 0.0)}, {"blarg": ("I", 3.0)}))
    at = dict(zip(toxicity.FEATURES, reader.features("You fool. Not a fool; he said fool! foolish blargun. A fool you are"), strict=True))
    assert at == {"insult": 2.0 + 3.0 + 2.0, "aimed": 2.0, "negated": 1.5, "reported": 1.5, "threat": 0.0}
    assert reader.features("nothing here") == [0.0] * len(toxicity.FEATURES)


def test_more_insults_always_count_more():
    reader = toxicity.Reader(toxicity.Lexicon({"fool": ("I", 2.0)}))
    sums = [reader.features("a fool. " * n)[0] for n in (1, 3, 50, 5000)]
    assert sums == sorted(set(sums))


def test_stems_are_learned_from_many_words(spark, labels):
    rows = [(k, f"vor mal {' '.join('zurbo' + 'abcdefghijklmnopqrstuvwxyz'[(k + j) % 26] * 2 for j in range(3)) if k % 8 == 0 else 'haus'} w{chr(97 + k % 17)}{chr(97 + k % 11)}x zeile {' '.join(chr(97 + (k * j) % 26) * 4 for j in range(3, 12))}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks_ = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(600)], "doc_id long, toxic int")
    model = toxicity.fit(df, marks_)
    assert any(s.startswith("zurb") for s in model.lexicon.stems)
    wrong = toxicity.score(df, model).join(marks_, "doc_id").where("predicted <> toxic").count()
    assert wrong == 0


def test_labels_outside_the_training_part_are_not_read(spark, documents, labels):
    part = remainder(F.col("doc_id"), 5) != 0
    flipped = labels.withColumn("toxic", F.when(part, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = toxicity.fit(documents, labels, where=part), toxicity.fit(documents, flipped, where=part)
    assert a.lexicon == b.lexicon and a.weights == b.weights
