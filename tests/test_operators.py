"""Operators on small tables, against literal restatements of their rules."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrivena.functions import text as tx
from scrivena.operators import cleaning as cl
from scrivena.operators import diagnostics as dg
from scrivena.operators import evaluation as ev
from scrivena.operators import features as ft
from scrivena.operators import integrity as it
from scrivena.operators import reporting as rp
from scrivena.operators import splits as sp
from scrivena.plans import staging
from scrivena.streaming import rolling

SPEECH = "id_speech long, id_person long, party string, election int, date date, time string, char_count long"


def speeches(spark, seed=1, authors=12, most=9):
    rng = random.Random(seed)
    rows, i = [], 0
    for a in range(authors):
        for _ in range(rng.randrange(1, most)):
            i += 1
            day = datetime.date(2000, 1, 1) + datetime.timedelta(rng.randrange(30))
            rows.append((i, a, rng.choice("ABC"), rng.choice([2001, 2005, 2009]), day, rng.choice(["09", "10"]), rng.randrange(0, 50) * 10))
    return rows, spark.createDataFrame(rows, SPEECH)


def by_author(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[4], r[5], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_latest_n(spark):
    rows, df = speeches(spark)
    test = {r[0] for own in by_author(rows).values() for r in own[-2:]}
    found = {r.id_speech for r in sp.latest_n(df, 2).collect() if r.outer_role == "test"}
    assert found == test


@pytest.mark.parametrize("share", [0.2, 0.5])
def test_char_share_peels_from_the_end(spark, share):
    rows, df = speeches(spark, 2)
    test = set()
    for own in by_author(rows).values():
        total, held, left = sum(r[6] for r in own), 0, list(own)
        while len(left) > 1:
            last = left.pop()
            test.add(last[0])
            held += last[6]
            if held >= share * total:
                break
    assert {r.id_speech for r in sp.char_share(df, share).collect() if r.outer_role == "test"} == test


@pytest.mark.parametrize("k", [2, 3, 5])
def test_char_buckets_are_filled_greedily(spark, k):
    rows, df = speeches(spark, k)
    expected = {}
    for own in by_author(rows).values():
        if len(own) < k:
            continue
        total, bucket, held, size = sum(r[6] for r in own), 0, 0, 0
        for i, r in enumerate(own):
            if bucket < k - 1 and size and i >= len(own) - (k - 1 - bucket):
                bucket, held, size = bucket + 1, 0, 0
            expected[r[0]] = bucket
            held, size = held + r[6], size + 1
            if bucket < k - 1 and held >= total / k:
                bucket, held, size = bucket + 1, 0, 0
    assert {r.id_speech: r.bucket for r in sp.char_buckets(df, k).collect()} == expected


def test_grouped_folds_are_disjoint_in_authors(spark):
    _, df = speeches(spark, 4)
    folds = sp.grouped_folds(df, 3, 7)
    for fold in range(3):
        train, val = ({r.id_person for r in folds.filter(f"fold_id = {fold} and fold_role = '{role}'").collect()} for role in ("train", "val"))
        assert not train & val and len(train | val) == 12 and len(val) == 4


def test_expanding_folds():
    assert sp.expanding_folds([2009, 2001, 2005, 2001]) == [(0, [2001], 2005), (1, [2001, 2005], 2009)]


def test_selection(spark):
    pool = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate([("A", 9), ("A", 8), ("A", 7), ("B", 6), ("B", 5), ("C", 4)])], "id_person long, party string, total_chars long")
    order = [r.id_person for r in sp.select_alternating(pool, 4).orderBy("place").collect()]
    assert order == [0, 3, 5, 1]
    assert {r.id_person for r in sp.select_with_party_minimum(pool, 4, 2).collect()} == {0, 1, 2}
    assert {r.id_person for r in sp.select_per_party(pool, 1).collect()} == {0, 3, 5}


def test_label_metrics_with_labels_on_one_side_only(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b"), (None, "a")], "y_true string, y_pred string")
    found = {r.label: (r.support, r.pred_count, r.correct_count, r.precision, r.recall, r.f1) for r in ev.label_metrics(df).collect()}
    assert found == {"a": (2, 1, 1, 1.0, 0.5, 2 / 3), "b": (0, 2, 0, 0.0, 0.0, 0.0), "c": (1, 0, 0, 0.0, 0.0, 0.0)}
    assert ev.label_metrics(df.limit(0)).count() == 0


def test_mcnemar_values(spark):
    a = spark.createDataFrame([(i, i < 8) for i in range(10)], "id_speech long, correct boolean")
    b = spark.createDataFrame([(i, i < 4) for i in range(10)], "id_speech long, correct boolean")
    r = ev.mcnemar(a, b).first()
    assert (r.only_a, r.only_b, r.chi2, r.chi2_corrected, r.significance) == (4, 0, 4.0, 2.25, "p<0.05")


@pytest.mark.parametrize("other", [[(1, True, "a"), (1, True, "a")], [(1, True, "a")], [(1, True, "a"), (2, True, "c")], [(1, True, "a"), (2, True, None)]])
def test_mcnemar_refuses_other_rows(spark, other):
    schema = "id_speech long, correct boolean, y_true string"
    with pytest.raises(Exception, match="each key once|labels differ"):
        ev.mcnemar(spark.createDataFrame([(1, True, "a"), (2, False, "b")], schema), spark.createDataFrame(other, schema)).collect()


def test_exact_quantiles_against_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, 0.5, rng.random()])) for _ in range(500)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    found = {r.g: (r.q0, r.q1, r.q2) for r in ev.exact_quantiles(df, ["g"], "x", {"q0": 0.0, "q1": 0.3, "q2": 0.975}).collect()}
    groups = {g: [x for h, x in rows if h == g and x is not None] for g in {g for g, _ in rows} - {"none"}}
    assert found.keys() == groups.keys()
    assert all(np.allclose(found[g], np.quantile(xs, [0, 0.3, 0.975])) for g, xs in groups.items())
    whole = ev.exact_quantiles(df, [], "x", {"q": 0.5}).first().q
    assert np.isclose(whole, np.median([x for _, x in rows if x is not None]))
    assert ev.exact_quantiles(df.limit(0), ["g"], "x", {"q": 0.5}).count() == 0


def test_ranked_scores_put_the_higher_class_first(spark):
    df = spark.createDataFrame([(1, 2, 0, 0.5), (1, 2, 1, 0.5), (1, 2, 2, 0.1)], "id long, true_class int, class int, score double")
    assert [t["class"] for t in ev.ranked_scores(df, "id", 2).first().top] == [1, 0]


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, "t", 0, [1.0, 0.0]), (2, "t", 1, [0.5, 0.5]), (3, "t", 5, [0.25, 0.75])], "id long, target string, y_true int, p array<double>")
    bins = {r.bin: (r.n, r.accuracy) for r in ev.reliability_curve(df, ["target"]).collect()}
    assert bins == {9: (1, 1.0), 5: (1, 0.0), 7: (1, 0.0)}


def test_imbalance_against_the_definition(spark):
    values = [0, 3, 3, 5, 9, 1]
    r = dg.imbalance(spark.createDataFrame([("x", v) for v in values], "k string, v long"), "v", ["k"]).first()
    own = sorted(v for v in values if v)
    n = len(own)
    gini = sum((2 * i - n - 1) * v for i, v in enumerate(own, 1)) / (n * sum(own))
    assert r.gini == pytest.approx(gini, abs=1e-8) and (r.least, r.most, r.n) == (1, 9, 5)


def test_majority_party_ties(spark):
    rows = [(1, 1, "A", "2001-01-01"), (2, 1, "B", "2001-01-02"), (3, 2, "A", "2001-01-01"), (4, 2, "B", "2001-01-01"), (5, 3, "C", "2001-01-01")]
    df = spark.createDataFrame(rows, "id_speech long, id_person long, party string, date string")
    assert sorted(r.id_speech for r in cl.majority_party_rows(df).collect()) == [2, 4, 5]


def test_small_parties_keep_rows_without_party(spark):
    df = spark.createDataFrame([(1, "A", 98), (2, "B", 2), (3, None, 5), (4, "C", 0)], "id_speech long, party string, word_count long")
    assert sorted(r.id_speech for r in cl.without_small_parties(df, 2.0).collect()) == [1, 2, 3]


def test_elections_and_procedural_rows(spark):
    df = spark.createDataFrame([(1, "2001", None, None), (2, "Valget 2005", "PRESIDENT ", None), (3, "x", "m", None), (4, "2009", "m", " "), (5, "2009", "m", "ja")], "id long, election string, status string, procedural string")
    assert sorted(r.id for r in cl.supported_elections(df, 2002).collect()) == [2, 4, 5]
    assert sorted(r.id for r in cl.without_procedural(df, ["president"]).collect()) == [1, 3, 4]


def test_age_is_imputed_from_one_known_year(spark):
    rows = [(1, 1, 1960, "2000-05-01"), (2, 1, None, "2001-05-01"), (3, 2, 1950, "2000-05-01"), (4, 2, 1951, "2000-05-01"), (5, 2, None, "2000-05-01")]
    df = spark.createDataFrame(rows, "id long, id_person long, birthyear int, date string").withColumn("date", F.to_date("date"))
    assert {r.id: r.age for r in cl.with_age(df).collect()} == {1: 40, 2: 41, 3: 50, 4: 49, 5: None}


def text_result(spark, expression, *values):
    return [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string").orderBy("k").select(expression(F.col("t")).alias("x")).collect()]


def test_text_is_normalised(spark):
    assert text_result(spark, tx.normalised_text, 'a­​b  c\n""" d', None, "") == ["ab c d", "", ""]


def test_spaces_after_punctuation(spark):
    given = ["Ja.Nei,jo;vel:så", "1.5 og 2,5", "i 2005.Det var", "kl 10:30", "www.example.no"]
    assert text_result(spark, tx.spaced_punctuation, *given) == ["Ja. Nei, jo; vel: så", "1.5 og 2,5", "i 2005. Det var", "kl 10:30", "www.example.no"]


def test_redaction_against_python(spark):
    names = ["Ås", "Kari Ås", "Ola", "Ma", "X", ""]
    texts = ["Kari Ås og Åse. kari ås, KARI ÅS's", "Olas ola OLA Ola-Ola", "<Ola> Ma.Ma Mat", None, "Kari  Ås"]
    pattern = re.compile(r"(?<![\w>])(?:K(?i:ari\s+Ås)|O(?i:la)|M(?i:a)|Å(?i:s))(?:['’]?s)?(?![\w<])")
    found = text_result(spark, lambda c: tx.redacted(c, names, "#"), *texts)
    for text, r in zip(texts, found):
        if text is not None:
            assert (r["text"], r["n"]) == pattern.subn("#", text)
    assert text_result(spark, lambda c: tx.redacted(c, [], "#"), "a")[0]["text"] == "a"


def test_redaction_by_a_table_equals_one_pattern(spark):
    rng = random.Random(7)
    words = ["Ås", "ås", "ÅS's", "Kari", "kari", "Olas", "Ola’s", "O.", "-Berg", "x", "Straß", "STRASS", "Bo\u200bb", "<Ola>", "İda", "ida", "a|b", "Ole  Bo"]
    names = ["Kari Ås", "Ola", "-Berg", "Straß", "O. Ås", "Bo\u200bb Ole", "İda", "a|b x", "--", None, " ", "Ole\u00a0Bo"]
    values = cl.name_candidates(spark.createDataFrame([(n, n) for n in names], "name string, extra string"), ["name", "absent"])
    plain = [r.value for r in values.collect()]
    assert {"Kari Ås", "Ås", "Bob", "Bob Ole", "Ole Bo", "--", "O."} <= set(plain) and len(plain) == len(set(plain)) and "x" not in plain
    texts = [(i % 90, " ".join(rng.choices(words, k=rng.randrange(0, 9))), 1) for i in range(100)] + [(None, "Kari -- Ås", 2), (5, None, 3), (6, "", 4)]
    df = spark.createDataFrame(texts, "id long, text string, _word int")
    found = sorted(map(str, cl.redacted_by(df, values, "<N>", "id").select("id", "text", "n", "_word").collect()))
    one = tx.redacted(F.col("text"), plain, "<N>")
    expected = df.select("id", one.alias("x"), "_word").select("id", "x.text", F.coalesce("x.n", F.lit(0)).alias("n"), "_word")
    assert found == sorted(map(str, expected.collect())) and sum("<N>" in r for r in found) > 20
    assert cl.redacted_by(df.limit(0), values, "<N>", "id").count() == 0
    assert cl.redacted_by(df, values.limit(0), "<N>", "id").filter("n > 0").count() == 0
    parties = spark.createDataFrame([(" Ap", None), ("H", "Høyre"), (None, None)], "party string, partyname string")
    assert {r.value for r in cl.party_candidates(parties, {"ap": ["Arbeiderpartiet"], "x": ["No"]}, ["H"]).collect()} == {"Arbeiderpartiet", "H", "Høyre"}


def test_ids_and_bins(spark):
    assert text_result(spark, tx.canonical_id, "12", "12.0", " 1e3", "x1", None, "12.5") == ["12", "12", "1000", "x1", "", "12.5"]
    assert text_result(spark, lambda c: tx.age_bin(c.cast("int"), [0, 30, 200]), "0", "29", "30", "200", None) == ["0-29", "0-29", "30-199", "unknown", "unknown"]


def test_vocabulary_is_applied_to_other_texts(spark):
    texts = spark.createDataFrame([(1, "train", "aa bb aa"), (2, "train", "bb cc"), (3, "eval", "aa dd dd"), (4, "eval", None), (5, "eval", "dd")], "id long, role string, text string")
    grams = ft.with_word_grams(texts, 1, 2, counted=True)
    terms = ft.vocabulary(grams.filter("role = 'train'"), 1, 3)
    idf = {r.term: r.idf for r in terms.collect()}
    assert idf.keys() == {"aa", "bb", "aa bb"} and idf["bb"] == pytest.approx(1.0) and idf["aa"] == pytest.approx(math.log(3 / 2) + 1)
    assert {(r.id, r.term, r.weight) for r in ft.tfidf_weights(grams.filter("role = 'eval'"), terms, 3).collect()} == {(3, "aa", 1.0)}
    both = [{tuple(r) for r in ft.tfidf_weights(grams, terms, most).collect()} for most in (3, ft.MOST_BROADCAST + 1)]
    assert both[0] == both[1]


def test_grams(spark):
    df = spark.createDataFrame([(1, "train", "Ab cd, e fg"), (2, "train", "ab"), (3, "train", None)], "id long, role string, text string")
    assert {r.id: r.grams for r in ft.with_word_grams(df, 1, 3).collect()} == {1: ["ab", "cd", "fg", "ab cd", "cd fg", "ab cd fg"], 2: ["ab"], 3: []}
    assert {r.id: r.grams for r in ft.with_char_grams(df, 2, 3).filter("id > 1").collect()} == {2: ["ab"], 3: []}


def test_integrity_counts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "q")], "k long, v string")
    assert it.duplicated_keys(a, "k").first().offending == 1
    assert it.missing_keys(a.filter("k is not null"), b, "k").first().offending == 1
    assert it.shared_keys(a, b, "k").first().offending == 1
    with pytest.raises(Exception, match="twice"):
        it.require(a, it.duplicated_keys(a, "k"), "twice").collect()
    assert it.require(b, it.duplicated_keys(b, "k"), "twice").count() == 2


def test_deltas_and_concentration(spark):
    rows = [("base", "a", 10, 5, 0.5), ("base", "b", 10, 9, 0.9), ("profiled", "a", 10, 7, 0.7), ("profiled", "b", 10, 9, 0.9)]
    m = spark.createDataFrame(rows, "system string, label string, support long, correct_count long, f1 double").withColumns({"recall": F.col("f1"), "precision": F.col("f1")})
    s = rp.delta_summary(rp.metric_deltas(m, "base", "profiled")).first()
    assert (s.improved, s.worse, s.unchanged, s.best_gain, s.best_loss) == (1, 0, 1, "a", "b") and s.weighted_delta == pytest.approx(0.1)
    top = rp.error_concentration(rp.author_rankings(m), [1]).filter("system = 'base'").first()
    assert (top.errors, top.labels) == (5, "a") and top.error_share == pytest.approx(5 / 6)


def test_staged_tables_are_reread(spark):
    df = staging.stage(spark.range(5).selectExpr("id", "id * 2 as x"), "test")
    assert df.agg(F.sum("x")).first()[0] == 20 and "Scan parquet" in df._jdf.queryExecution().toString().replace("FileScan", "Scan")


def test_label_counts_on_a_stream(spark, tmp_path):
    rows = [(1, "2020-01-01 10:00:00", "a", 1.5), (2, "2020-01-01 11:00:00", "a", 2.5), (3, "2020-01-02 00:00:00", "b", 1.0)]
    table = spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    table.write.parquet(f"{tmp_path}/events")
    stream = rolling.label_counts(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/events"))
    run = stream.writeStream.format("memory").queryName("label_counts_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    run.awaitTermination(60)
    assert sorted(map(tuple, spark.table("label_counts_test").collect())) == sorted(map(tuple, rolling.label_counts(table).collect()))


def test_timeline_of_a_stream_lets_months_go(spark, tmp_path):
    """In append mode a month comes out once; an event is kept until its month is over and the lateness has passed."""
    days = [(1, "2024-01-30"), (1, "2024-02-28"), (1, "2024-01-31"), (2, "2024-03-05"), (1, "2024-05-01"), (1, "2024-05-02")]
    schema = "user_id long, ts timestamp"
    for k, (user, day) in enumerate(days):
        spark.createDataFrame([(user, datetime.datetime.fromisoformat(day))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = rolling.author_timeline(spark.readStream.schema(schema).parquet(f"{tmp_path}/events"))
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(60)
    found = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert found == [(1, "2024-01-01 00:00:00", 2), (1, "2024-02-01 00:00:00", 1), (2, "2024-03-01 00:00:00", 1)]
