"""Queries of splits, folds, author selection and their diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivena.operators import assembly as ab
from scrivena.operators import diagnostics as dg
from scrivena.operators import splits as sp
from scrivena.plans.registry import query
from scrivena.sources import views
from scrivena.sources.views import with_views



def plain(df):
    """Dates as text, which reads the same in either engine."""
    return df.withColumns({name: F.col(name).cast("string") for name, kind in df.dtypes if kind == "date"})


TEXT_DATES = " select * replace (first_date::varchar as first_date, last_date::varchar as last_date) from ("

N_TEST, SHARE, K, SEED = 3, 0.2, 3, 42
TRAIN, TEST = [1995, 1997, 1999], [2001]
MIN_CHARS = 100_000
ELECTIONS = [1995, 1997, 1999, 2001]
FOLDS = sp.expanding_folds(ELECTIONS)

NEWEST = "row_number() over (partition by id_person order by date desc, time desc, id_speech desc)"
LATEST = f", outer_m as (select id_speech, id_person, election, party, case when {NEWEST} <= {N_TEST} then 'test' else 'train' end as outer_role from speech)"
DRAW = f"(id_person * 48271 + {SEED}) % 2147483647"
GROUPED = f""", auth as (select id_person, min(party) as party from speech group by 1), bk as (
  select id_person, ((row_number() over (order by party nulls last, {DRAW}, id_person) - 1) % {K})::int as bucket from auth
), folds as (
  select id_speech, id_person, fold_id, case when bucket = fold_id then 'val' else 'train' end as fold_role from speech join bk using (id_person), (select unnest(range({K}))::int as fold_id)
)"""
TIMED = ", roles(fold_id, election, fold_role) as (values " + ", ".join([f"({f}, {e}, 'train')" for f, t, _ in FOLDS for e in t] + [f"({f}, {v}, 'val')" for f, _, v in FOLDS]) + """), folds as (
  select id_speech, id_person, fold_id::int as fold_id, fold_role from speech join roles using (election)
)"""
FOLD_STATS = """, fs as (
  select id_person, fold_id, coalesce(sum(char_count) filter (fold_role = 'train'), 0)::bigint as train_chars, coalesce(sum(char_count) filter (fold_role = 'val'), 0)::bigint as val_chars,
         count(*) filter (fold_role = 'train') as train_speeches, count(*) filter (fold_role = 'val') as val_speeches
  from folds join speech using (id_speech, id_person) group by all
)"""
POOL = ", pool as (select id_person, arg_max(party, (date, time, id_speech)) as party, sum(char_count)::bigint as total_chars, count(*) as total_speeches from speech group by id_person)"


def grouped(spark, d):
    return sp.grouped_folds(views.speech(spark, d), K, SEED)


def timed(spark, d):
    return sp.temporal_folds(views.speech(spark, d), FOLDS)


@query("split_latest_n", with_views("speech", LATEST + " select * from outer_m"))
def split_latest_n(spark, d):
    return sp.latest_n(views.speech(spark, d), N_TEST)


@query("split_char_share", with_views("speech", f""", o as (
  select *, coalesce(sum(char_count) over (partition by id_person order by date, time, id_speech rows between 1 following and unbounded following), 0) as later,
         row_number() over (partition by id_person order by date, time, id_speech) as a, {NEWEST} as z, sum(char_count) over (partition by id_person) as total from speech
)
select id_speech, id_person, election, party, case when a > 1 and (z = 1 or later < {SHARE}::double * total) then 'test' else 'train' end as outer_role from o"""))
def split_char_share(spark, d):
    return sp.char_share(views.speech(spark, d), SHARE)


PEELED = """, o as (
  select *, row_number() over a - 1 as place, sum(char_count) over (partition by id_person) as whole, count(*) over (partition by id_person) as n,
         coalesce(sum(char_count) over (partition by id_person order by date, time, id_speech rows between 1 following and unbounded following), 0) as later
  from speech window a as (partition by id_person order by date, time, id_speech)
), t as (select *, place >= 2 and (place = n - 1 or later < 0.2::double * whole) as test from o),
u as (
  select *, count(*) filter (not test) over (partition by id_person) as n2,
         coalesce(sum(char_count) filter (not test) over (partition by id_person order by date, time, id_speech rows between 1 following and unbounded following), 0) as later2
  from t
)"""


@query("split_char_shares", with_views("speech", PEELED + """
select id_speech, id_person, election, party,
       case when test then 'test' when place >= 1 and (place = n2 - 1 or later2 < 0.1::double * whole) then 'val' else 'train' end as outer_role from u"""))
def split_char_shares(spark, d):
    return sp.char_shares(views.speech(spark, d), {"train": 0.7, "val": 0.1, "test": 0.2})


ROUNDS = 25


@query("pool_fixed_point", with_views("speech", POOL.replace("with ", "") + f""", base as (
  select p.*, l.language, e.election from pool p join (select id_person, arg_max(language, (date, time, id_speech)) as language from speech group by 1) l using (id_person)
  join (select id_person, arg_max(election, (date, time, id_speech)) as election from speech group by 1) e using (id_person) where id_person % 10 <> 7
), r as (
  with recursive x(k, id_person, party, language, election) as (
    select 0, id_person, party, language, election from base where party <> 'MACHINERY'
    union all select k + 1, id_person, party, language, election from (
      select *, count(*) over (partition by party) as a, count(*) over (partition by language) as b, count(*) over (partition by election) as c from x
    ) where a >= 4 and b >= 6 and c >= 5 and k < {ROUNDS}
  ) select id_person, party, language, election from x where k = {ROUNDS}
) select * from r"""))
def pool_fixed_point(spark, d):
    speeches = views.speech(spark, d)
    latest = lambda c: F.max_by(c, F.struct(*sp.ORDER)).alias(c)
    pool = speeches.groupBy("id_person").agg(latest("party"), latest("language"), latest("election"))
    excluded = pool.filter("id_person % 10 = 7").select(F.concat(F.col("id_person").cast("string"), F.lit(".0")).alias("id_person"))
    parties = [r.party for r in pool.select("party").distinct().collect() if r.party != "MACHINERY"]  # parties
    return sp.filtered_pool(sp.without_authors(pool, excluded), {"party": 4, "language": 6, "election": 5}, {"party": parties})


@query("role_rows", with_views("speech", LATEST + GROUPED + """, u as (
  select 'final' as unit, 'test' as eval_role, id_speech, outer_role as role from outer_m union all select fold_id::varchar, 'val', id_speech, fold_role from folds
)
select u.id_speech, unit, eval_role, role, 'latest' as split_name, outer_role, language, s.election, id_person as author, s.party, female, char_count, word_count
from u join speech s using (id_speech) join (select id_speech, outer_role from outer_m) using (id_speech)"""))
def role_rows(spark, d):
    """Membership of all units with row data, targets and features, put together by one grouping."""
    speeches = views.speech(spark, d)
    outer = sp.latest_n(speeches, N_TEST)
    folds = grouped(spark, d)
    members = sp.units(outer, folds, "final").unionByName(sp.units(outer, folds, "all")).drop("id_person")
    sources = {
        "data": ab.row_data(speeches, outer, "latest", ["language", "election", "not_there"]),
        "targets": ab.targets(speeches, ["party", "female"]),
        "features": speeches.select("id_speech", "char_count", "word_count"),
    }
    return ab.assembled(members, sources)


@query("split_temporal", with_views("speech", f""", o as (
  select *, case when election in (1995, 1997, 1999) then 'train' else 'test' end as outer_role, row_number() over (partition by id_person, election = 2001 order by date desc, time desc, id_speech desc) as z
  from speech where election in (1995, 1997, 1999, 2001)
)
select id_speech, id_person, election, party, outer_role from o where outer_role = 'train' or z <= {N_TEST}"""))
def split_temporal(spark, d):
    return sp.temporal(views.speech(spark, d), TRAIN, TEST, N_TEST)


@query("split_grouped", with_views("speech", POOL + """, sel as (select id_person from pool order by total_chars desc, id_person limit 50)
select id_speech, id_person, election, party, 'train' as outer_role from speech where id_person in (select id_person from sel)"""))
def split_grouped(spark, d):
    speeches = views.speech(spark, d)
    return sp.grouped_outer(speeches, sp.select_top(sp.author_pool(speeches), 50))


BUCKETS = f""", o as (
  select id_speech, id_person, char_count, row_number() over (partition by id_person order by date, time, id_speech) - 1 as i, count(*) over (partition by id_person) as n, sum(char_count) over (partition by id_person) as total from speech
), walk(id_person, i, id_speech, bucket, next_bucket, held, size) as (
  select id_person, i, id_speech, 0, case when char_count * {K} >= total then 1 else 0 end, case when char_count * {K} >= total then 0 else char_count end, case when char_count * {K} >= total then 0 else 1 end
  from o where i = 0 and n >= {K}
  union all
  select id_person, i, id_speech, b, b + case when full_ then 1 else 0 end, case when full_ then 0 else h end, case when full_ then 0 else s end
  from (
    select *, b < {K} - 1 and h * {K} >= total as full_ from (
      select o.id_person, o.i, o.id_speech, o.total, w.next_bucket + case when f then 1 else 0 end as b, case when f then 0 else w.held end + o.char_count as h, case when f then 1 else w.size + 1 end as s
      from (select *, w.next_bucket < {K} - 1 and w.size > 0 and w.i + 1 >= (select 0) + n_ - ({K} - 1 - w.next_bucket) as f from (select walk.*, o2.n as n_ from walk join o o2 on o2.id_person = walk.id_person and o2.i = walk.i) w) w
      join o on o.id_person = w.id_person and o.i = w.i + 1
    )
  )
)"""


@query("folds_char_buckets", with_views("speech", BUCKETS + f"""
select id_speech, id_person, fold_id, case when bucket = fold_id then 'val' else 'train' end as fold_role from walk, (select unnest(range({K}))::int as fold_id)""").replace("with speech", "with recursive speech"))
def folds_char_buckets(spark, d):
    return sp.folds_of_buckets(sp.char_buckets(views.speech(spark, d), K), K)


@query("folds_expanding", with_views("speech", TIMED + " select * from folds"))
def folds_expanding(spark, d):
    return timed(spark, d)


@query("folds_grouped_stratified", with_views("speech", GROUPED + " select * from folds"))
def folds_grouped_stratified(spark, d):
    return grouped(spark, d)


@query("author_stats", with_views("speech", LATEST + """
select id_person, coalesce(sum(char_count) filter (outer_role = 'train'), 0)::bigint as train_chars, coalesce(sum(char_count) filter (outer_role = 'test'), 0)::bigint as test_chars,
       count(*) filter (outer_role = 'train') as train_speeches, count(*) filter (outer_role = 'test') as test_speeches
from outer_m join speech using (id_speech, id_person) group by id_person"""))
def author_stats(spark, d):
    speeches = views.speech(spark, d)
    return sp.author_stats(speeches, sp.latest_n(speeches, N_TEST))


@query("author_fold_stats", with_views("speech", TIMED + FOLD_STATS + " select * from fs"))
def author_fold_stats(spark, d):
    return sp.author_fold_stats(views.speech(spark, d), timed(spark, d))


@query("fold_coverage_filter", with_views("speech", TIMED + FOLD_STATS + f"""
select id_person, count(*) as folds, min(train_chars) as least_train_chars, min(val_chars) as least_val_chars from fs group by id_person
having count(*) = {len(FOLDS)} and min(train_chars) >= {MIN_CHARS} and min(val_chars) >= {MIN_CHARS}"""))
def fold_coverage_filter(spark, d):
    return sp.covered_authors(author_fold_stats(spark, d), len(FOLDS), MIN_CHARS, MIN_CHARS)


@query("temporal_coverage_filter", with_views("speech", f""", e as (select id_person, election, sum(char_count)::bigint as chars from speech where election in (1995, 1997, 1999, 2001) group by all having sum(char_count) >= {MIN_CHARS})
select id_person, count(*) as elections, min(chars) as least_chars from e group by id_person having count(*) = 4"""))
def temporal_coverage_filter(spark, d):
    return sp.authors_in_all_elections(views.speech(spark, d), ELECTIONS, MIN_CHARS)


@query("infeasible_folds", with_views("speech", TIMED + FOLD_STATS + POOL + f""", sel as (select id_person from pool order by total_chars desc, id_person limit 20), h as (
  select fold_id, count(distinct id_person) filter (fold_role = 'train') as train_authors, count(distinct id_person) filter (fold_role = 'val') as val_authors
  from folds where id_person in (select id_person from sel) group by fold_id
)
select *, train_authors = 20 and val_authors = 20 as feasible from h"""))
def infeasible_folds(spark, d):
    return sp.feasible_folds(timed(spark, d), sp.select_top(sp.author_pool(views.speech(spark, d)), 20))


@query("select_top_chars", with_views("speech", POOL + " select * from pool order by total_chars desc, id_person limit 25"))
def select_top_chars(spark, d):
    return sp.select_top(sp.author_pool(views.speech(spark, d)), 25)


@query("select_per_party", with_views("speech", POOL + " select *, row_number() over (partition by party order by total_chars desc, id_person)::int as party_rank from pool qualify party_rank <= 4"))
def select_per_party(spark, d):
    return sp.select_per_party(sp.author_pool(views.speech(spark, d)), 4)


@query("select_alternating", with_views("speech", POOL + """, r as (select *, row_number() over (partition by party order by total_chars desc, id_person) as party_rank from pool),
t as (select party, row_number() over (order by max(total_chars) desc, party) as turn from pool group by party)
select id_person, party, total_chars, row_number() over (order by party_rank, turn)::int as place from r join t using (party) qualify place <= 12"""))
def select_alternating(spark, d):
    return sp.select_alternating(sp.author_pool(views.speech(spark, d)), 12)


@query("refill_selection", with_views("speech", POOL + """, r as (select *, row_number() over (order by total_chars desc, id_person)::int as place from pool),
g as (select party from r where place <= 15 group by party having count(*) >= 3)
select id_person, party, total_chars, row_number() over (order by total_chars desc, id_person)::int as place from r where party in (select party from g) order by place limit 15"""))
def refill_selection(spark, d):
    return sp.select_with_party_minimum(sp.author_pool(views.speech(spark, d)), 15, 3)


@query("sample_per_author", with_views("speech", f" select id_speech, id_person from speech qualify row_number() over (partition by id_person order by (id_speech * 48271 + {SEED}) % 2147483647, id_speech) <= 2"))
def sample_per_author(spark, d):
    return sp.sample_per_author(views.speech(spark, d), 2, SEED)


SUPPORT = TIMED + """, su as (
  select id_person, fold_id, fold_role, count(*) as speeches, sum(char_count)::bigint as chars, min(date) as first_date, max(date) as last_date, min(election) as first_election, max(election) as last_election
  from folds join speech using (id_speech, id_person) group by all
), cells as (
  select id_person, fold_id, speeches, chars, case when chars < 150000 and speeches < 2 then 'low_chars+low_speeches' when chars < 150000 then 'low_chars' when speeches < 2 then 'low_speeches' else '' end as reason
  from su where fold_role = 'val'
)"""


def support(spark, d):
    return dg.support_summary(views.speech(spark, d), timed(spark, d))


def cells(spark, d):
    return dg.reliability_cells(support(spark, d), 150_000, 2)


@query("support_summary", with_views("speech", SUPPORT + TEXT_DATES + "from su)"))
def support_summary(spark, d):
    return plain(support(spark, d))


@query("reliability_cells", with_views("speech", SUPPORT + " select *, reason = '' as reliable from cells"))
def reliability_cells(spark, d):
    return cells(spark, d)


@query("author_reliability", with_views("speech", SUPPORT + """
select id_person, count(*) as cells, count(*) filter (reason = '') as reliable_cells, count(*) filter (reason <> '') as excluded_cells, min(chars) as least_chars, median(chars) as median_chars,
       coalesce(array_to_string(list_sort(list_distinct(list(reason) filter (reason <> ''))), '|'), '') as reasons, count(*) filter (reason = '') = 0 as fully_excluded from cells group by id_person"""))
def author_reliability(spark, d):
    return dg.author_reliability(cells(spark, d))


@query("fold_author_summary", with_views("speech", SUPPORT + """, x as (select fold_id, count(*) filter (reason <> '') as excluded_cells from cells group by fold_id) """ + TEXT_DATES + """
select fold_id, fold_role, count(*) as authors, min(chars) as least_chars, median(chars) as median_chars, min(speeches) as least_speeches, median(speeches) as median_speeches,
       min(first_date) as first_date, max(last_date) as last_date, max(excluded_cells) as excluded_cells from su left join x using (fold_id) group by fold_id, fold_role)"""))
def fold_author_summary(spark, d):
    return plain(dg.fold_author_summary(support(spark, d), cells(spark, d)))


@query("imbalance_gini", with_views("speech", TIMED + """, v as (select fold_id, fold_role, id_person, sum(char_count)::bigint as chars from folds join speech using (id_speech, id_person) group by all),
r as (select *, row_number() over (partition by fold_id, fold_role order by chars, id_person) as i, count(*) over (partition by fold_id, fold_role) as n from v where chars > 0)
select fold_id, fold_role, count(*) as n, min(chars) as least, max(chars) as most, sum(chars) / count(*)::double as mean, median(chars) as median, round(stddev_pop(chars), 4) as sd,
       max(chars) / min(chars)::double as ratio, round(sum((2 * i - n - 1) * chars) / (count(*) * sum(chars))::double, 9) as gini from r group by fold_id, fold_role"""))
def imbalance_gini(spark, d):
    return dg.imbalance(support(spark, d), "chars", ["fold_id", "fold_role"])


@query("split_stats", with_views("speech", LATEST + TEXT_DATES + """
select coalesce(outer_role, 'all') as outer_role, count(*) as speeches, count(distinct id_person) as authors, count(distinct s.party) as parties, sum(char_count)::bigint as chars, median(char_count) as median_chars,
       min(s.election) as first_election, max(s.election) as last_election, min(date) as first_date, max(date) as last_date
from outer_m o join speech s using (id_speech, id_person) group by rollup (outer_role))"""))
def split_stats(spark, d):
    speeches = views.speech(spark, d)
    return plain(dg.split_stats(speeches, sp.latest_n(speeches, N_TEST).select("id_speech", "outer_role")))


LONG = """, l as (
  select outer_role, id_person, target, label from (
    select outer_role, s.id_person, unnest(['party', 'female', 'language']) as target, unnest([s.party, female::varchar, language]) as label from outer_m o join speech s using (id_speech)
  )
)"""


@query("label_distribution", with_views("speech", LATEST + LONG + """, c as (select target, outer_role, coalesce(label, 'missing') as label, count(*) as n from l group by all)
select *, n / sum(n) over (partition by target, outer_role)::double as share, count(*) over (partition by target, outer_role) as labels, row_number() over (partition by target, outer_role order by n desc, label) = 1 as majority from c"""))
def label_distribution(spark, d):
    speeches = views.speech(spark, d)
    rows = sp.latest_n(speeches, N_TEST).select("id_speech", "outer_role").join(speeches, "id_speech")
    return dg.label_distribution(rows, ["party", "female", "language"], "outer_role")


@query("target_summary", with_views("speech", LATEST + LONG + " select target, count(distinct label) as classes, count(label) as rows, count(distinct id_person) as authors from l where label is not null group by target"))
def target_summary(spark, d):
    return dg.target_summary(views.speech(spark, d), ["party", "female", "language"])


def balance_sql(whole: str, rows: str) -> str:
    return with_views("speech", GROUPED + f""", f as (select fold_id, fold_role, id_speech, folds.id_person, party as label from folds join speech using (id_speech)),
{whole}, ex as (select label, sum(w) / sum(sum(w)) over () as expected from wh group by label), {rows},
sh as (select fold_id, fold_role, label, sum(w) / sum(sum(w)) over (partition by fold_id, fold_role) as share from ro group by fold_id, fold_role, label),
g as (select u.fold_id, u.fold_role, ex.label, round(100 * (coalesce(share, 0) - expected), 6) as points from (select distinct fold_id, fold_role from sh) u cross join ex left join sh using (fold_id, fold_role, label))
select fold_id, fold_role, max(abs(points)) as max_points, arg_max(label, (points, label)) as most_over, arg_min(label, (points, label)) as most_under from g group by fold_id, fold_role""")


def folded(spark, d):
    return grouped(spark, d).join(views.speech(spark, d).select("id_speech", "party"), "id_speech")


@query("fold_balance", balance_sql("wh as (select distinct id_speech, label, 1.0::double as w from f)", "ro as (select *, 1.0::double as w from f)"))
def fold_balance(spark, d):
    return dg.fold_balance(folded(spark, d), "party")


@query("fold_balance_weighted", balance_sql(
    "wh as (select *, 1.0::double / count(*) over (partition by id_person) as w from (select distinct id_speech, id_person, label from f))",
    "ro as (select *, 1.0::double / count(*) over (partition by fold_id, fold_role, id_person) as w from f)",
))
def fold_balance_weighted(spark, d):
    return dg.fold_balance(folded(spark, d), "party", "author")


@query("fold_balance_author", balance_sql(
    "wh as (select id_person, label, 1.0::double as w from (select id_person, label, count(distinct id_speech) as n from f group by all) qualify row_number() over (partition by id_person order by n desc, label) = 1)",
    "ro as (select u.fold_id, u.fold_role, wh.label, 1.0::double as w from (select distinct fold_id, fold_role, id_person from f) u join wh using (id_person))",
))
def fold_balance_author(spark, d):
    return dg.fold_balance(folded(spark, d), "party", "modal")


@query("training_timeline", with_views("speech", " select id_person, year(date)::int as year, count(*) as speeches from speech group by all"))
def training_timeline(spark, d):
    return views.speech(spark, d).groupBy("id_person", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("speeches"))
