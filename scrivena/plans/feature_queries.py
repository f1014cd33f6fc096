"""Queries of text features, TF-IDF, scaling, selection of candidates, importance and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivena.functions import text as tx
from scrivena.operators import evaluation as ev
from scrivena.operators import features as ft
from scrivena.operators import integrity as it
from scrivena.operators import selection as se
from scrivena.operators import splits as sp
from scrivena.plans.registry import query
from scrivena.plans.reporting_queries import labels_sql
from scrivena.plans.split_queries import GROUPED, LATEST, N_TEST, grouped
from scrivena.sources import views
from scrivena.sources.tables import table
from scrivena.sources.views import with_views

WORDS = ["the", "of", "and", "la", "der", "und", "que", "og"]


def texts(spark, d):
    """(id, text, lang, role): a third of the documents are held out."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.when(F.col("doc_id") % 3 == 0, "eval").otherwise("train").alias("role"))


TEXTS = "texts as (select doc_id as id, text, lang, case when doc_id % 3 = 0 then 'eval' else 'train' end as role from documents)"
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


def over(top: str, bottom: str) -> str:
    return f"coalesce(({top}) / nullif({bottom}, 0)::double, 0)"


LEN = "length(coalesce(text, ''))"
KINDS = {"share_alpha": r"\p{L}", "share_digit": r"\p{N}", "share_space": r"\s"}


def kind_count(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))"


@query("char_distribution", f"with {TEXTS} select id, " + ", ".join(over(f"{LEN} - length(replace(lower(coalesce(text, '')), '{c}', ''))", LEN) + f" as letter_{k:02d}" for k, c in enumerate(tx.LETTERS)) + ", " + ", ".join(over(kind_count(p), LEN) + f" as {n}" for n, p in KINDS.items()) + ", " + over(f"{LEN} - " + " - ".join(kind_count(p) for p in KINDS.values()), LEN) + " as share_other from texts")
def char_distribution(spark, d):
    return ft.char_distribution(texts(spark, d), "id")


@query("function_words", f"with {TEXTS}, t as (select id, {TOKENS} as t from texts) select id, " + ", ".join(over(f"len(list_filter(t, lambda x: x = '{w}'))", "len(t)") + f" as word_{w}" for w in WORDS) + ", " + over("len(list_filter(t, lambda x: x in (" + ", ".join(f"'{w}'" for w in WORDS) + ")))", "len(t)") + " as share_listed from t")
def function_words(spark, d):
    return ft.function_words(texts(spark, d), "id", WORDS)


COUNTS = f"""with {TEXTS}, t as (select id, role, lang, {TOKENS} as t, greatest(len(regexp_extract_all(coalesce(text, ''), '[.!?]+')), 1)::bigint as n_sentences from texts), k as (
  select id, role, lang, len(t)::bigint as n_tokens, n_sentences, len(list_filter(t, lambda x: length(x) > 6))::bigint as n_long, length(array_to_string(t, ''))::bigint as n_chars from t
), c as (select *, {over('n_chars', 'n_tokens')} as mean_token_length, {over('n_tokens', 'n_sentences')} + {over('100 * n_long', 'n_tokens')} as lix, {over('n_long', 'n_sentences')} as rix from k)"""
LONG = COUNTS + ", l as (select id, role, lang, feature, value::double as value from (unpivot (select id, role, lang, n_tokens::double as n_tokens, n_sentences::double as n_sentences, n_long::double as n_long, n_chars::double as n_chars, mean_token_length, lix, rix from c) on n_tokens, n_sentences, n_long, n_chars, mean_token_length, lix, rix into name feature value value))"


def counts(spark, d):
    rows = texts(spark, d)
    return rows.select("id", "role", "lang").join(ft.text_counts(rows, "id"), "id")


def long(spark, d):
    return ft.long_features(counts(spark, d), ["id", "role", "lang"], ft.TEXT_COUNTS)


@query("text_counts", COUNTS + " select * exclude (role, lang) from c")
def text_counts(spark, d):
    return ft.text_counts(texts(spark, d), "id")


@query("feature_quality", LONG + """, s as (
  select lang, feature, count(*) as n, sum(value) as s, sum(value * value) as q, count(*) filter (value = 0) as z from l group by all
  union all select 'all', feature, count(*), sum(value), sum(value * value), count(*) filter (value = 0) from l group by feature
), m as (select *, s / n as mean, greatest(q / n - (s / n) * (s / n), 0) as variance from s)
select lang, feature, n, round(mean, 6) as mean, round(variance, 4) as variance, z / n::double as zero_share, z = n as all_zero, variance < 0.01 as low_variance from m""")
def feature_quality(spark, d):
    return ft.feature_quality(long(spark, d), "lang", 0.01)


DRIFT = LONG + f""", dr as (
  select feature, avg(value) filter (role = 'train') as a, avg(value) filter (role = 'eval') as b, var_pop(value) filter (role = 'train') as va, var_pop(value) filter (role = 'eval') as vb from l group by feature
), drift as (select feature, round(a, 6) as train_mean, round(b, 6) as eval_mean, round(b - a, 6) as gap, round({over('abs(b - a)', 'sqrt((va + vb) / 2)')}, 6) as standard_gap from dr)"""


@query("feature_drift", DRIFT + " select * from drift")
def feature_drift(spark, d):
    return ft.feature_drift(long(spark, d))


@query("drift_summary", DRIFT + """ select count(*) as features, round(avg(standard_gap), 5) as mean_gap, round(median(standard_gap), 5) as median_gap, max(standard_gap) as max_gap,
  count(*) filter (standard_gap > 0.5) as above_half, count(*) filter (standard_gap > 1) as above_one from drift""")
def drift_summary(spark, d):
    return ft.drift_summary(ft.feature_drift(long(spark, d)))


@query("standard_scale", LONG + ", f as (select feature, avg(value) as m, stddev_pop(value) as sd from l where role = 'train' group by feature) select id, feature, round((value - m) / sd, 4) as z from l join f using (feature) where sd > 0")
def standard_scale(spark, d):
    return ft.standard_scaled(long(spark, d), "id")


@query("feature_non_finite", LONG + " select role, feature, 0::bigint as bad from l group by all")
def feature_non_finite(spark, d):
    return ft.non_finite_counts(counts(spark, d), "role", ft.TEXT_COUNTS)


def tfidf_sql(grams: str, items: str, min_df: int, most: int) -> str:
    return f"""with {TEXTS}, g as (select id, role, term, count(*) as tf from (select id, role, unnest({grams}) as term from (select id, role, {items} as w from texts)) group by id, role, term),
v as (select term, count(*) as df, sum(tf) as total from g where role = 'train' group by term having count(*) >= {min_df} order by total desc, term limit {most}),
w as (select id, g.term, tf * (ln((1.0 + (select count(*) from texts where role = 'train')) / (1.0 + df)) + 1.0) as w from g join v on g.term = v.term)
select id, term, round(w / sqrt(sum(w * w) over (partition by id)), 6) as weight from w"""


PLAIN = "regexp_replace(lower(coalesce(text, '')), '[\\s\\x0B]+', ' ', 'g')"
LONG_WORDS = f"list_filter({TOKENS}, lambda x: length(x) > 1)"


def runs_sql(low: int, high: int, between: str) -> str:
    """Runs of low to high neighbouring items of the list w."""
    found = []
    for n in range(low, high + 1):
        parts = ", ".join(f"w[{k + 1}:{k - n}]" if k < n - 1 else f"w[{k + 1}:]" for k in range(n))
        joined = f" || '{between}' || ".join(f"x[{k + 1}]" for k in range(n))
        found.append("w" if n == 1 else f"list_transform(list_zip({parts}), lambda x: {joined})")
    return f"list_concat({', '.join(found)})"


@query("tfidf_word", tfidf_sql(runs_sql(1, 3, " "), LONG_WORDS, 5, 100_000))
def tfidf_word(spark, d):
    return ft.tfidf_of_texts(texts(spark, d), "word", 1, 3, 5, 100_000)


@query("tfidf_char", tfidf_sql(runs_sql(2, 5, ""), f"string_split({PLAIN}, '')", 5, 100_000))
def tfidf_char(spark, d):
    return ft.tfidf_of_texts(texts(spark, d), "char", 2, 5, 5, 100_000)


BLOCK = "case when feature like 'n\\_%' escape '\\' then 'counts' else 'style' end"


@query("feature_block_norm", LONG + f""", b as (select id, {BLOCK} as block, feature, value from l),
o as (select id, block, feature, coalesce(value / nullif(sqrt(sum(value * value) over (partition by id, block)), 0), 0) * case block when 'counts' then 2.0 else 0.5 end as value from b)
select id, block, feature, round(coalesce(value / nullif(sqrt(sum(value * value) over (partition by id)), 0), 0), 6) as value from o""")
def feature_block_norm(spark, d):
    rows = long(spark, d).withColumn("block", F.when(F.col("feature").startswith("n_"), "counts").otherwise("style"))
    return ft.block_normalised(rows, {"counts": 2.0, "style": 0.5})


@query("hard_labels", with_views("proba", ", h as (select id_speech, list_position(p, list_max(p)) as b from proba) select id_speech, (b = 1)::int as c0, (b = 2)::int as c1, (b = 3)::int as c2 from h"))
def hard_labels(spark, d):
    hard = views.probabilities(spark, d).select("id_speech", ft.hard_labels().alias("h"))
    return hard.select("id_speech", *(F.col("h")[k].alias(f"c{k}") for k in range(3)))


@query("one_hot", with_views("proba", " select id_speech, (y_true = 0)::int as c0, (y_true = 2)::int as c2, 0 as c9 from proba"))
def one_hot(spark, d):
    hot = views.probabilities(spark, d).select("id_speech", ft.one_hot(F.col("y_true"), [0, 2, 9]).alias("h"))
    return hot.select("id_speech", *(F.col("h")[k].alias(f"c{c}") for k, c in enumerate([0, 2, 9])))


@query("align_proba", with_views("proba", " select id_speech, p[3] as a, 0.0::double as b, p[1] as c from proba"))
def align_proba(spark, d):
    rows = views.probabilities(spark, d).select("id_speech", ft.aligned(F.col("p"), ["x", "y", "z"], ["z", "w", "x"]).alias("q"))
    return rows.select("id_speech", F.col("q")[0].alias("a"), F.col("q")[1].alias("b"), F.col("q")[2].alias("c"))


# candidates: six, of three conditions, measured on five units

CANDIDATES = """, cd as (select *, (id_speech % 6)::int as candidate_id, ((id_speech % 6) // 2)::int as condition_id, fold_id as unit_id,
  case id_speech % 6 when 0 then 'char+word' when 1 then 'char+prob_sex' when 2 then 'char+hard_sex' when 3 then 'word+prob_age' when 4 then 'char+prob_sex+hard_sex' else 'word' end as blocks from pred),
m as (""" + labels_sql("cd", "candidate_id, condition_id, blocks, unit_id") + """), cm as (select candidate_id, condition_id, blocks, unit_id, round(avg(f1), 9) as macro_f1 from m group by all),
su as (select candidate_id, condition_id, blocks, count(*) as units, round(avg(macro_f1), 9) as mean, round(stddev_samp(macro_f1), 6) as sd from cm group by all)"""
KEYS = ["candidate_id", "condition_id", "blocks"]


def candidate_metrics(spark, d):
    i = F.col("id_speech") % 6
    blocks = F.when(i == 0, "char+word").when(i == 1, "char+prob_sex").when(i == 2, "char+hard_sex").when(i == 3, "word+prob_age").when(i == 4, "char+prob_sex+hard_sex").otherwise("word")
    rows = views.prediction(spark, d).withColumns({"candidate_id": i.cast("int"), "condition_id": F.floor(i / 2).cast("int"), "blocks": blocks, "unit_id": F.col("fold_id")})
    return ev.overall_metrics(rows, [*KEYS, "unit_id"])


def summary(spark, d):
    return se.candidate_summary(candidate_metrics(spark, d), KEYS, "macro_f1")


@query("candidate_summary", with_views("pred", CANDIDATES + " select *, row_number() over (order by mean desc, candidate_id, condition_id, blocks)::int as rank from su"))
def candidate_summary(spark, d):
    return summary(spark, d)


@query("condition_select", with_views("pred", CANDIDATES + " select condition_id, candidate_id, 1 as place, mean from su qualify row_number() over (partition by condition_id order by mean desc, candidate_id) = 1"))
def condition_select(spark, d):
    return se.best_by_condition(summary(spark, d), "condition_id", "candidate_id")


@query("candidate_rankings", with_views("pred", CANDIDATES + " select condition_id, candidate_id, row_number() over (partition by condition_id order by mean desc, candidate_id)::int as place, mean from su"))
def candidate_rankings(spark, d):
    return se.best_by_condition(summary(spark, d), "condition_id", "candidate_id", 2)


@query("selection_margin", with_views("pred", CANDIDATES + """, r as (select *, row_number() over w as place, lead(mean) over w as next_mean from su window w as (partition by condition_id order by mean desc, candidate_id))
select condition_id, candidate_id, mean, next_mean, round(mean - next_mean, 9) as margin from r where place = 1"""))
def selection_margin(spark, d):
    return se.selection_margin(summary(spark, d), "condition_id", "candidate_id")


@query("fold_stability", with_views("pred", CANDIDATES + """ select candidate_id, round(avg(macro_f1), 9) as mean, round(stddev_samp(macro_f1), 6) as sd, min(macro_f1) as least, max(macro_f1) as most,
  arg_max(unit_id, (macro_f1, unit_id)) as best_unit, arg_min(unit_id, (macro_f1, unit_id)) as worst_unit from cm group by candidate_id"""))
def fold_stability(spark, d):
    return se.fold_stability(candidate_metrics(spark, d), ["candidate_id"], "macro_f1")


@query("block_comparison", with_views("pred", CANDIDATES + """ select case when blocks like '%prob\\_%' escape '\\' and blocks like '%hard\\_%' escape '\\' then 'mixed' when blocks like '%prob\\_%' escape '\\' then 'probability' when blocks like '%hard\\_%' escape '\\' then 'hard' else 'base' end as kind,
  count(*) as candidates, round(avg(mean), 7) as mean_of_means, round(median(mean), 7) as median_of_means, max(mean) as best_mean, arg_max(candidate_id, (mean, candidate_id)) as best_candidate from su group by 1"""))
def block_comparison(spark, d):
    return se.block_comparison(summary(spark, d).withColumn("kind", se.block_kind(F.col("blocks"))), "kind", "candidate_id")


@query("stylometry_decision", DRIFT + ", pred as (" + views.SQL["pred"] + ")" + CANDIDATES.replace("m as (", "mm as (", 1).replace("from m group", "from mm group") + """, j as (select (select max(mean) from su) as best_mean, (select max(standard_gap) from drift) as max_gap)
select *, case when best_mean >= 0.4 and max_gap <= 1.0 then 'go' else 'no-go' end as decision, case when best_mean >= 0.4 and max_gap <= 1.0 then '' when best_mean >= 0.4 then 'drift' when max_gap <= 1.0 then 'score' else 'score+drift' end as reason from j""")
def stylometry_decision(spark, d):
    return se.decision(summary(spark, d), ft.feature_drift(long(spark, d)), 0.4, 1.0)


COEF = """with co as (select p_brand as class, case p_size % 3 when 0 then 'word' when 1 then 'char' else 'stylo' end as block, p_type as feature, sum((p_partkey * 7919) % 2003 - 1001)::bigint / 1000.0::double as coef from part group by all),
gi as (select block, feature, round(avg(abs(coef)), 9) as mean_abs, max(abs(coef)) as max_abs from co group by all)"""


def coefficients(spark, d):
    part = table(spark, d, "part")
    block = F.when(F.col("p_size") % 3 == 0, "word").when(F.col("p_size") % 3 == 1, "char").otherwise("stylo")
    return part.groupBy(F.col("p_brand").alias("class"), block.alias("block"), F.col("p_type").alias("feature")).agg((F.sum((F.col("p_partkey") * 7919) % 2003 - 1001) / 1000.0).alias("coef"))


@query("feature_importance_global", COEF + " select *, round(mean_abs / sum(mean_abs) over (), 9) as share from gi")
def feature_importance_global(spark, d):
    return se.global_importance(coefficients(spark, d))


@query("feature_importance_block", COEF + ", s as (select block, count(*) as features, round(sum(mean_abs), 6) as total from gi group by block) select *, round(total / sum(total) over (), 6) as share from s")
def feature_importance_block(spark, d):
    return se.grouped_importance(se.global_importance(coefficients(spark, d)), ["block"])


@query("feature_importance_subfamily", COEF + ", s as (select block, left(feature, 1) as family, count(*) as features, round(sum(mean_abs), 6) as total from gi group by all) select *, round(total / sum(total) over (), 6) as share from s")
def feature_importance_subfamily(spark, d):
    return se.grouped_importance(se.global_importance(coefficients(spark, d)).withColumn("family", F.left("feature", F.lit(1))), ["block", "family"])


@query("feature_importance_top_features", COEF + """, r as (select *, row_number() over (partition by class order by coef desc, block, feature)::int as up, row_number() over (partition by class order by coef, block, feature)::int as down from co)
select class, 'positive' as direction, up as place, block, feature, coef from r where up <= 3 union all select class, 'negative', down, block, feature, coef from r where down <= 3""")
def feature_importance_top_features(spark, d):
    return se.top_features(coefficients(spark, d), 3)


@query("integrity_checks", with_views("speech pred", GROUPED + LATEST + """, c as (
  select 'unique_speeches' as "check", (select count(*) from (select id_speech from speech group by 1 having count(*) > 1)) as offending
  union all select 'speeches_have_roles', (select count(distinct id_speech) from speech where id_speech not in (select id_speech from outer_m))
  union all select 'authors_in_train_and_test', (select count(*) from (select id_person from outer_m where outer_role = 'train' intersect select id_person from outer_m where outer_role = 'test'))
  union all select 'same_truth', (select count(*) from speech s full join pred p using (id_speech) where s.partyname is distinct from p.y_true)
  union all select 'labels_in_train', (select count(*) from (select distinct fold_id, party from folds join speech using (id_speech) where fold_role = 'val' except select distinct fold_id, party from folds join speech using (id_speech) where fold_role = 'train'))
)
select *, offending = 0 as passed from c"""))
def integrity_checks(spark, d):
    s = views.speech(spark, d)
    outer = sp.latest_n(s, N_TEST)
    truth = views.prediction(spark, d).select("id_speech", F.col("y_true").alias("partyname"))
    return it.report(
        {
            "unique_speeches": it.duplicated_keys(s, "id_speech"),
            "speeches_have_roles": it.missing_keys(s, outer, "id_speech"),
            "authors_in_train_and_test": it.shared_keys(outer.filter("outer_role = 'train'"), outer.filter("outer_role = 'test'"), "id_person"),
            "same_truth": it.disagreeing(s, truth, "id_speech", "partyname"),
            "labels_in_train": it.uncovered_labels(grouped(spark, d).join(s.select("id_speech", "party"), "id_speech"), "party"),
        }
    )
