"""Queries of cleaning and of the descriptive tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrivena.functions import text as tx
from scrivena.operators import cleaning as cl
from scrivena.plans.registry import query
from scrivena.sources import views
from scrivena.sources.tables import table
from scrivena.sources.views import with_views

RAW = """, raw as (
  select id_speech, id_person, date, time, word_count, language, case when id_speech % 4 = 0 then (select min(party) from speech) when id_speech % 23 = 1 then '  ' when id_speech % 23 = 2 then ' NaN' when id_speech % 23 = 3 then null when id_speech % 23 = 5 then ' ' || party || ' ' else party end as party,
         case id_speech % 17 when 0 then '2021-02-30' when 1 then '01.02.1999' else date::varchar end as date_text,
         case id_speech % 13 when 0 then 'Valget ' || election when 1 then 'unknown' else election::varchar end as election_text,
         case id_speech % 11 when 0 then ' President ' when 1 then null else 'member' end as status, case id_speech % 19 when 0 then 'yes' when 1 then ' ' end as procedural,
         (case when id_speech % 3 = 0 then null when id_person % 7 = 0 then 1940 + id_speech % 2 else 1930 + id_person % 50 end)::int as birthyear,
         case when id_speech % 5 = 0 then null else partyname end as partyname
  from speech
)"""


def raw(spark, d):
    """Speeches with faults: invalid dates, elections in words, missing values, changed, blank and padded parties."""
    s = views.speech(spark, d)
    i = F.col("id_speech")
    first = s.agg(F.min("party").alias("_first"))
    return s.crossJoin(F.broadcast(first)).select(  # first: one row
        "id_speech", "id_person", "date", "time", "word_count", "language",
        F.when(i % 4 == 0, F.col("_first")).when(i % 23 == 1, "  ").when(i % 23 == 2, " NaN").when(i % 23 == 3, None).when(i % 23 == 5, F.concat(F.lit(" "), "party", F.lit(" "))).otherwise(F.col("party")).alias("party"),
        F.when(i % 17 == 0, "2021-02-30").when(i % 17 == 1, "01.02.1999").otherwise(F.col("date").cast("string")).alias("date_text"),
        F.when(i % 13 == 0, F.concat(F.lit("Valget "), "election")).when(i % 13 == 1, "unknown").otherwise(F.col("election").cast("string")).alias("election_text"),
        F.when(i % 11 == 0, " President ").when(i % 11 == 1, None).otherwise("member").alias("status"),
        F.when(i % 19 == 0, "yes").when(i % 19 == 1, " ").alias("procedural"),
        F.when(i % 3 == 0, None).when(F.col("id_person") % 7 == 0, 1940 + i % 2).otherwise(1930 + F.col("id_person") % 50).cast("int").alias("birthyear"),
        F.when(i % 5 == 0, None).otherwise(F.col("partyname")).alias("partyname"),
    )


@query("clean_dates", with_views("speech", RAW + " select id_speech, try_strptime(date_text, '%Y-%m-%d')::date::varchar as date_text from raw where try_strptime(date_text, '%Y-%m-%d') is not null"))
def clean_dates(spark, d):
    return cl.clean_dates(raw(spark, d), "date_text").select("id_speech", F.col("date_text").cast("string").alias("date_text"))


ELECTION = "coalesce(try_cast(election_text as int), try_cast(nullif(regexp_extract(election_text, '((?:19|20)[0-9]{2})', 1), '') as int))"


@query("supported_elections", with_views("speech", RAW + f" select id_speech, {ELECTION} as election_text from raw where {ELECTION} >= 1997"))
def supported_elections(spark, d):
    return cl.supported_elections(raw(spark, d), 1997, "election_text").select("id_speech", "election_text")


PROCEDURAL = "lower(trim(coalesce(status, ''))) not in ('president', 'presidenten') and trim(coalesce(procedural, '')) = ''"


@query("procedural_filter", with_views("speech", RAW + f" select id_speech from raw where {PROCEDURAL}"))
def procedural_filter(spark, d):
    return cl.without_procedural(raw(spark, d), ["president", "presidenten"]).select("id_speech")


AGED = ", aged as (select *, coalesce(birthyear, case when min(birthyear) over (partition by id_person) = max(birthyear) over (partition by id_person) then min(birthyear) over (partition by id_person) end) as b from raw)"


@query("impute_birthyear_age", with_views("speech", RAW + AGED + " select id_speech, b as birthyear, (year(date) - b)::int as age from aged"))
def impute_birthyear_age(spark, d):
    return cl.with_age(raw(spark, d)).select("id_speech", "birthyear", "age")


@query("complete_profiles", with_views("speech", RAW + " select id_speech from raw where birthyear is not null and partyname is not null"))
def complete_profiles(spark, d):
    return cl.complete_profiles(raw(spark, d), ["birthyear", "partyname"]).select("id_speech")


@query("fill_partyname", with_views("speech", RAW + """, u as (
  select upper(trim(party)) as k, partyname from raw where partyname is not null group by upper(trim(party)), partyname qualify row_number() over (partition by upper(trim(party)) order by count(*) desc, partyname) = 1
)
select id_speech, coalesce(raw.partyname, u.partyname) as partyname from raw left join u on k = upper(trim(party))"""))
def fill_partyname(spark, d):
    return cl.with_party_names(raw(spark, d)).select("id_speech", "partyname")


CODED = ", coded as (select * replace (trim(party) as party) from raw where lower(trim(party)) not in ('', 'nan', 'none', '<na>'))"


@query("party_shares", with_views("speech", RAW + CODED + " select party, sum(word_count)::bigint as words, round(100.0::double * sum(word_count) / sum(sum(word_count)) over ()::double, 6) as percent from coded group by party"))
def party_shares(spark, d):
    return cl.party_shares(raw(spark, d))


SMALL = CODED + ", sm as (select language, party from coded group by language, party qualify round(100.0::double * sum(word_count) / sum(sum(word_count)) over (partition by language)::double, 6) < 17)"


@query("small_party_filter", with_views("speech", RAW + CODED + ", al as (select party from coded group by party qualify round(100.0::double * sum(word_count) / sum(sum(word_count)) over ()::double, 6) < 17) select id_speech from raw where coalesce(trim(party), '') not in (select party from al)"))
def small_party_filter(spark, d):
    return cl.without_small_parties(raw(spark, d), 17).select("id_speech")


@query("small_party_by_language", with_views("speech", RAW + SMALL + " select id_speech from raw where language in ('ASIA', 'EUROPE') and (language, coalesce(trim(party), '')) not in (select (language, party) from sm)"))
def small_party_by_language(spark, d):
    return cl.without_small_parties_by_language(raw(spark, d), 17, ["ASIA", "EUROPE"]).select("id_speech")


@query("party_switchers", with_views("speech", RAW + CODED + """, f as (select id_person, party, min((date, time, id_speech)) as since from coded group by all)
select id_person, count(*) as n_parties, string_agg(party, '>' order by since) as parties from f group by id_person having count(*) > 1"""))
def party_switchers(spark, d):
    return cl.party_switchers(raw(spark, d))


@query("majority_party", with_views("speech", RAW + CODED + """, m as (
  select id_person, party as main from coded group by id_person, party
  qualify row_number() over (partition by id_person order by count(*) desc, max(date) desc, party desc) = 1 and count(*) over (partition by id_person) > 1
) select id_speech from raw left join m using (id_person) where main is null or trim(party) = main"""))
def majority_party(spark, d):
    return cl.majority_party_rows(raw(spark, d)).select("id_speech")


@query("majority_language", with_views("speech", """, r as (select * replace (case when id_speech % 3 = 0 then 'AFRICA' else language end as language) from speech), m as (
  select id_person, language from r group by id_person, language qualify row_number() over (partition by id_person order by count(*) desc, (language = 'EUROPE') desc, language) = 1
) select id_speech, language from r join m using (id_person, language)"""))
def majority_language(spark, d):
    rows = views.speech(spark, d).withColumn("language", F.when(F.col("id_speech") % 3 == 0, "AFRICA").otherwise(F.col("language")))
    return cl.majority_language_rows(rows, "EUROPE").select("id_speech", "language")


@query("short_filter", with_views("speech", " select id_speech, word_count from speech where word_count >= 20000"))
def short_filter(spark, d):
    return views.speech(spark, d).filter("word_count >= 20000").select("id_speech", "word_count")


@query("dedup_first", "select min(doc_id) as doc_id, source, lang from documents group by source, lang, text")
def dedup_first(spark, d):
    return cl.first_of_duplicates(table(spark, d, "documents"), ["source", "lang", "text"], "doc_id").select("doc_id", "source", "lang")


@query("stage_audit", with_views("speech", RAW + f""", a as (select * from raw where try_strptime(date_text, '%Y-%m-%d') is not null), b as (select * from a where {ELECTION} >= 1997), c as (select * from b where {PROCEDURAL}),
n as (select 0 as stage_no, 'input' as stage, count(*) as rows, count(distinct id_person) as authors from raw union all select 1, 'dates', count(*), count(distinct id_person) from a
      union all select 2, 'elections', count(*), count(distinct id_person) from b union all select 3, 'procedural', count(*), count(distinct id_person) from c)
select *, coalesce(lag(rows) over (order by stage_no), rows) - rows as rows_removed, coalesce(lag(authors) over (order by stage_no), authors) - authors as authors_removed from n"""))
def stage_audit(spark, d):
    stages = [
        ("dates", lambda df: cl.clean_dates(df, "date_text")),
        ("elections", lambda df: cl.supported_elections(df, 1997, "election_text")),
        ("procedural", lambda df: cl.without_procedural(df, ["president", "presidenten"])),
    ]
    return cl.audited(raw(spark, d), stages)


@query("corpus_overview", with_views("speech", """, w as (select 100.0::double * sum(f) / count(*) as female_percent from (select max(female) as f from speech group by id_person))
select count(*) as speeches, count(distinct id_person) as authors, count(distinct party) as parties, count(distinct election) as elections, min(election) as first_election, max(election) as last_election,
       sum(word_count)::bigint as words, sum(char_count)::bigint as chars, sum(word_count) / count(word_count)::double as mean_words, median(word_count) as median_words, (select female_percent from w) as female_percent from speech"""))
def corpus_overview(spark, d):
    return cl.corpus_overview(views.speech(spark, d))


GROUPED = "count(*) as speeches, count(distinct id_person) as authors, sum(word_count)::bigint as words, sum(word_count) / count(word_count)::double as mean_words, median(word_count) as median_words"


@query("election_stats", with_views("speech", f" select election, {GROUPED} from speech where election is not null group by election"))
def election_stats(spark, d):
    return cl.grouped_overview(views.speech(spark, d), "election")


@query("party_stats", with_views("speech", f" select party, {GROUPED} from speech where party is not null group by party"))
def party_stats(spark, d):
    return cl.grouped_overview(views.speech(spark, d), "party")


@query("author_overview", with_views("speech", """ select id_person, arg_min(name, (date, time, id_speech)) as name, arg_min(party, (date, time, id_speech)) as party, min(language) as main_language, count(*) as speeches,
       sum(word_count)::bigint as words, min(date)::varchar as first_date, max(date)::varchar as last_date from speech group by id_person"""))
def author_overview(spark, d):
    return cl.author_overview(views.speech(spark, d))


POINTS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


@query("length_percentiles", with_views("speech", ", q as (select " + ", ".join(f"quantile_cont(word_count, {p}) as q{k}" for k, p in enumerate(POINTS)) + " from speech) " + " union all ".join(f"select {p}::double as percentile, floor(q{k})::bigint as value from q" for k, p in enumerate(POINTS))))
def length_percentiles(spark, d):
    return cl.percentiles(views.speech(spark, d), "word_count", POINTS)


@query("age_stats", with_views("speech", ", q as (select quantile_cont(age, 0.1) as a, quantile_cont(age, 0.5) as b, quantile_cont(age, 0.9) as c from speech) select 0.1::double as percentile, floor(a)::bigint as value from q union all select 0.5, floor(b)::bigint from q union all select 0.9, floor(c)::bigint from q"))
def age_stats(spark, d):
    return cl.percentiles(views.speech(spark, d), "age", [0.1, 0.5, 0.9])


@query("language_stats", with_views("speech", " select election, language, count(*) as n, 100.0::double * count(*) / sum(count(*)) over (partition by election)::double as percent from speech group by election, language"))
def language_stats(spark, d):
    return cl.shares(views.speech(spark, d), "election", "language")


@query("length_threshold", with_views("speech", ", q as (select quantile_cont(word_count, 0.99) as p from speech) select max(p) as p99, count(*) filter (word_count <= p) as up_to_p99, count(*) filter (word_count > p) as above_p99, count(*) filter (word_count < 20000) as below_threshold from speech, q"))
def length_threshold(spark, d):
    return cl.threshold_report(views.speech(spark, d), "word_count", 20000)


@query("age_bins", with_views("speech", " select id_speech, case when age >= 20 and age < 30 then '20-29' when age >= 30 and age < 50 then '30-49' when age >= 50 and age < 70 then '50-69' else 'unknown' end as age_bin from speech"))
def age_bins(spark, d):
    return views.speech(spark, d).select("id_speech", tx.age_bin(F.col("age"), [20, 30, 50, 70]).alias("age_bin"))


@query("party_axis", with_views("speech", " select id_speech, case when party in ('AUTOMOBILE', 'BUILDING') then 'left' when party = 'FURNITURE' then 'center' when party = 'MACHINERY' then 'right' else 'unknown' end as axis from speech"))
def party_axis(spark, d):
    axes = {"left": ["Auto-mobile", "building"], "center": ["FURNITURE"], "right": [" machinery"]}
    return views.speech(spark, d).select("id_speech", tx.party_axis(F.col("party"), axes).alias("axis"))


@query("normalize_text", """select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\u200b\u200c\u200d\u2060\ufeff\u00ad]', '', 'g'), '[\u00a0\u202f]', ' ', 'g'), '"{3,}', '', 'g'), '[\\s\\x0B]+', ' ', 'g')) as text from documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalised_text(F.col("text")).alias("text"))


@query("punct_spacing")
def punct_spacing(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.spaced_punctuation(F.col("text")).alias("text"))


NAME_VALUES = """, v as (select distinct trim(regexp_replace(x, '\\s+', ' ', 'g')) as value from (select name as x from speech union all select partyname from speech) where x is not null)
select value from v where value <> '' union select p from (select unnest(string_split(value, ' ')) as p from v) where length(p) >= 2"""


@query("name_candidates", with_views("speech", NAME_VALUES))
def name_candidates(spark, d):
    return cl.name_candidates(views.speech(spark, d), ["name", "partyname", "name_original"])


@query("party_candidates", with_views("speech", """ select partyname as value from speech union select party from speech where party in ('BUILDING', 'MACHINERY')
union select unnest(['Home', 'House Wares']) from speech where lower(party) = 'household'"""))
def party_candidates(spark, d):
    return cl.party_candidates(views.speech(spark, d), {"household": ["Home", "House  Wares"], "none": ["Nothing"]}, ["BUILDING", "MACHINERY", "none"])


@query("redact_names")
def redact_names(spark, d):
    """Names are the first two words of the first document of each source, and their parts."""
    docs = table(spark, d, "documents")
    names = docs.groupBy("source").agg(F.min_by(F.regexp_extract("text", r"^\S+\s+\S+", 0), "doc_id").alias("name"))
    return cl.redacted_by(docs.select("doc_id", "text"), cl.name_candidates(names, ["name"]), "<NAME>", "doc_id")


@query("length_features", "select doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0B]+'), lambda x: x <> ''))::bigint as word_count, length(coalesce(text, ''))::bigint as char_count from documents")
def length_features(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).alias("word_count"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("char_count"))


@query("truncate_head_tail", "select doc_id, len(w)::bigint as n, array_to_string(case when len(w) > 12 then list_concat(w[1:8], w[-4:]) else w end, ' ') as kept from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s\\x0B]+'), lambda x: x <> '') as w from documents)")
def truncate_head_tail(spark, d):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\s\x0B]+"), lambda w: w != "")
    rows = table(spark, d, "documents").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(tx.head_and_tail(F.col("w"), 8, 4), " ").alias("kept"))


@query("canonical_ids", "select doc_id, case when doc_id % 3 = 0 then doc_id::varchar when doc_id % 3 = 1 then doc_id::varchar else 'x' || doc_id end as id from documents")
def canonical_ids(spark, d):
    i = F.col("doc_id")
    given = F.when(i % 3 == 0, F.concat(i.cast("string"), F.lit(".0"))).when(i % 3 == 1, F.concat(F.lit(" "), i.cast("string"))).otherwise(F.concat(F.lit("x"), i.cast("string")))
    return table(spark, d, "documents").select("doc_id", tx.canonical_id(given).alias("id"))


FIXES = [("  CUSTOMER#000000004", None, 30), ("customer#000000007", "1996-01-01", 41), ("Customer#000000007", "1997-06-01", 42)]


@query("reviewed_fixes", with_views("speech", """, fx(name, since, value) as (values ('customer#000000004', null, 30), ('customer#000000007', '1996-01-01', 41), ('customer#000000007', '1997-06-01', 42))
select id_speech, coalesce((select arg_max(value, coalesce(since, '')) from fx where fx.name = lower(s.name) and (since is null or since::date <= s.date)), age)::int as age from speech s"""))
def reviewed_fixes(spark, d):
    fixes = spark.createDataFrame(FIXES, "name string, since string, value int").withColumn("since", F.to_date("since"))
    return cl.with_fixes(views.speech(spark, d), fixes, "age").select("id_speech", "age")


@query("author_party_distribution", with_views("speech", """, a as (select id_person, arg_min(party, (date, time, id_speech)) as party from speech group by 1)
select party, count(*) as count, 100.0::double * count(*) / sum(count(*)) over () as pct from a group by party"""))
def author_party_distribution(spark, d):
    return cl.distribution(cl.author_overview(views.speech(spark, d)), "party")


@query("author_language_distribution", with_views("speech", """, n as (select id_person, language, count(*) as n from speech group by all),
a as (select id_person, language as main_language from n qualify row_number() over (partition by id_person order by n desc, language) = 1)
select main_language, count(*) as count, 100.0::double * count(*) / sum(count(*)) over () as pct from a group by main_language"""))
def author_language_distribution(spark, d):
    return cl.distribution(cl.author_overview(views.speech(spark, d)), "main_language")


@query("language_filter", with_views("speech", " select id_speech, language, party from speech where language in ('ASIA', 'EUROPE')"))
def language_filter(spark, d):
    return cl.with_columns_only(cl.supported_languages(views.speech(spark, d), ["ASIA", "EUROPE"]), ["id_speech", "gone", "language", "party"])


@query("profile_labels", with_views("speech", """ select id_speech, case party when 'BUILDING' then 'builders' else party end as label, id_person % 3 = 1 as is_flagged from speech"""))
def profile_labels(spark, d):
    raw_flag = F.element_at(F.array(F.lit("No"), F.lit(" TRUE "), F.lit(None).cast("string")), (F.col("id_person") % 3 + 1).cast("int"))
    return views.speech(spark, d).select("id_speech", tx.label(F.col("party"), {"BUILDING": "builders"}).alias("label"), tx.flag(raw_flag).alias("is_flagged"))
