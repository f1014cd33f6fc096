"""Train/test splits and folds: chronological, by period, by share of characters, by author.

Rows are speeches with id_speech, id_person, party, election, date, time and
char_count.  An author's speeches are ordered by date, time and id_speech, so
every assignment is a function of the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivena.functions.text import canonical_id
from scrivena.plans.staging import stage

ORDER = ["date", "time", "id_speech"]
MEMBER = ["id_speech", "id_person", "election", "party"]


def _newest_first() -> list[Column]:
    return [F.col(c).desc() for c in ORDER]


def latest_n(speeches: DataFrame, n: int) -> DataFrame:
    """outer_role: each author's n latest speeches are test, the others train."""
    place = F.row_number().over(Window.partitionBy("id_person").orderBy(*_newest_first()))
    return speeches.select(*MEMBER, F.when(place <= n, "test").otherwise("train").alias("outer_role"))


def char_share(speeches: DataFrame, share: float) -> DataFrame:
    """outer_role: an author's latest speeches are test until they hold ``share`` of the author's characters.

    A speech is test when what comes after it is still below that share; the latest always is, the
    first never, so an author with one speech has no test rows.
    """
    w = Window.partitionBy("id_person")
    later = F.coalesce(F.sum("char_count").over(w.orderBy(*ORDER).rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    first = F.row_number().over(w.orderBy(*ORDER)) == 1
    last = F.row_number().over(w.orderBy(*_newest_first())) == 1
    test = ~first & (last | (later < share * F.sum("char_count").over(w)))
    return speeches.select(*MEMBER, F.when(test, "test").otherwise("train").alias("outer_role"))


def char_shares(speeches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """outer_role: an author's speeches in order, dealt to the roles of ``shares`` (earliest role first) from the latest back.

    A role takes speeches until it holds its share of the author's characters, one at least, but leaves one for each role
    before it; the first role has the rest.  Roles with a share of 0 get nothing.  Each role's bounds hang on those of the role
    after it, so roles are taken in turn; all windows deal and sort by author alike, so rows are shuffled once.
    """
    roles = [r for r, share in shares.items() if share > 0]
    if not roles:
        raise ValueError("no role has a share")
    by = Window.partitionBy("id_person")
    after = by.orderBy(*ORDER).rowsBetween(1, Window.unboundedFollowing)
    rows = speeches.select(*MEMBER, "date", "time", "char_count").withColumns(
        {"_place": F.row_number().over(by.orderBy(*ORDER)) - 1, "_whole": F.sum("char_count").over(by), "outer_role": F.lit(None).cast("string")}
    )
    for earlier in range(len(roles) - 1, 0, -1):
        free = F.col("outer_role").isNull()
        rows = rows.withColumns({"_end": F.count_if(free).over(by), "_later": F.coalesce(F.sum(F.when(free, F.col("char_count"))).over(after), F.lit(0))})
        taken = free & (F.col("_place") >= earlier) & ((F.col("_place") == F.col("_end") - 1) | (F.col("_later") < shares[roles[earlier]] * F.col("_whole")))
        rows = rows.withColumn("outer_role", F.when(taken, roles[earlier]).otherwise(F.col("outer_role")))
    return rows.select(*MEMBER, F.coalesce("outer_role", F.lit(roles[0])).alias("outer_role"))


def temporal(speeches: DataFrame, train: list[int], test: list[int], n: int | None = None) -> DataFrame:
    """outer_role by election; at most the n latest test speeches of an author if n is given; other elections are left out."""
    role = F.when(F.col("election").isin(train), "train").when(F.col("election").isin(test), "test")
    rows = speeches.withColumn("outer_role", role).filter("outer_role is not null")
    if n is not None:
        place = F.row_number().over(Window.partitionBy("id_person", "outer_role").orderBy(*_newest_first()))
        rows = rows.withColumn("_place", place).filter((F.col("outer_role") == "train") | (F.col("_place") <= n))
    return rows.select(*MEMBER, "outer_role")


def char_buckets(speeches: DataFrame, k: int) -> DataFrame:
    """id_speech, id_person, bucket: each author's speeches in order, in k runs of about equal characters.

    A run is closed once it holds total / k characters, or when each later run needs one of the rows
    that are left.  Authors with fewer than k speeches have none.  Run by run, its last row is the first
    that fills it; all windows share one shuffle and one sort, and none gathers an author's rows.
    """
    w = Window.partitionBy("id_person")
    ordered = w.orderBy(*ORDER)
    rows = speeches.select(
        "id_speech",
        "id_person",
        (F.row_number().over(ordered) - 1).alias("i"),
        F.sum("char_count").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"),
        F.count(F.lit(1)).over(w).alias("n"),
        F.sum("char_count").over(w).alias("total"),
    ).filter(F.col("n") >= k)
    rows = rows.withColumns({"start": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "bucket": F.lit(0)})
    for b in range(k - 1):
        full = F.when((F.col("i") >= F.col("start")) & ((F.col("sum") - F.col("base")) * k >= F.col("total")), F.col("i"))
        latest = F.col("n") - (k - 1 - b) - 1
        rows = rows.withColumn("end", F.greatest("start", F.least(F.coalesce(F.min(full).over(w), latest), latest)))
        rows = rows.withColumns(
            {
                "base": F.max(F.when(F.col("i") == F.col("end"), F.col("sum"))).over(w),
                "start": F.col("end") + 1,
                "bucket": F.when(F.col("i") > F.col("end"), b + 1).otherwise(F.col("bucket")),
            }
        )
    return rows.select("id_speech", "id_person", "bucket")


def folds_of_buckets(buckets: DataFrame, k: int) -> DataFrame:
    """id_speech, id_person, fold_id, fold_role: fold i validates on bucket i and trains on the others."""
    wide = buckets.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return wide.select("id_speech", "id_person", "fold_id", F.when(F.col("bucket") == F.col("fold_id"), "val").otherwise("train").alias("fold_role"))


def expanding_folds(elections: list[int], least_train: int = 1) -> list[tuple[int, list[int], int]]:
    """(fold, elections to train on, election to validate on): each fold trains on all that came before."""
    ordered = sorted(set(elections))
    return [(i - least_train, ordered[:i], ordered[i]) for i in range(least_train, len(ordered))]


def temporal_folds(speeches: DataFrame, folds: list[tuple[int, list[int], int]]) -> DataFrame:
    """id_speech, id_person, fold_id, fold_role by election."""
    roles = [(fold, e, "train") for fold, train, _ in folds for e in train] + [(fold, val, "val") for fold, _, val in folds]
    table = speeches.sparkSession.createDataFrame(roles, "fold_id int, election int, fold_role string")
    return speeches.join(F.broadcast(table), "election").select("id_speech", "id_person", "fold_id", "fold_role")  # a row per fold and election


def dealt_in_turn(authors: DataFrame, k: int, seed: int, ranges: int = 256) -> DataFrame:
    """id_person, bucket: authors in the order of party, a draw from ``seed`` and id, dealt over k buckets in turn.

    Places are counted within ranges of the draw and set off by the sizes of the ranges before, so that
    no task orders all authors; what is ordered in one place has a row for each party and range.
    """
    span = 2147483647
    drawn = authors.withColumn("draw", (F.col("id_person") * 48271 + seed) % span).withColumn("range", F.floor(F.col("draw") * ranges / span))
    sizes = drawn.groupBy("party", "range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy(F.col("party").asc_nulls_last(), "range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("party").alias("_party"), F.col("range").alias("_range"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("party", "range").orderBy("draw", "id_person"))
    joined = drawn.withColumn("place", place).join(offsets, F.col("party").eqNullSafe(F.col("_party")) & (F.col("range") == F.col("_range")))
    return joined.select("id_person", ((F.col("offset") + F.col("place") - 1) % k).cast("int").alias("bucket"))


def grouped_folds(speeches: DataFrame, k: int, seed: int) -> DataFrame:
    """id_speech, id_person, fold_id, fold_role: authors are dealt over k buckets, party by party, in an order drawn from ``seed``.

    Dealing to the smallest bucket, the first of equal ones, is dealing in turn.
    """
    authors = speeches.groupBy("id_person").agg(F.min("party").alias("party"))
    return folds_of_buckets(speeches.select("id_speech", "id_person").join(dealt_in_turn(authors, k, seed), "id_person"), k)


def grouped_outer(speeches: DataFrame, authors: DataFrame) -> DataFrame:
    """All speeches of the selected authors are train."""
    return speeches.join(authors.select("id_person").distinct(), "id_person", "left_semi").select(*MEMBER, F.lit("train").alias("outer_role"))


def sample_per_author(speeches: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n speeches of each author, drawn by an integer hash of id and seed."""
    draw = (F.col("id_speech") * 48271 + seed) % 2147483647
    place = F.row_number().over(Window.partitionBy("id_person").orderBy(draw, "id_speech"))
    return speeches.withColumn("_place", place).filter(F.col("_place") <= n).select("id_speech", "id_person")


# which authors and folds are usable


def author_stats(speeches: DataFrame, outer: DataFrame) -> DataFrame:
    """id_person, train/test characters and speeches, and their share: one pass of conditional sums."""
    rows = outer.select("id_speech", "outer_role").join(speeches.select("id_speech", "id_person", "char_count"), "id_speech")
    train, test = F.col("outer_role") == "train", F.col("outer_role") == "test"
    return rows.groupBy("id_person").agg(
        F.sum(F.when(train, F.col("char_count")).otherwise(0)).alias("train_chars"),
        F.sum(F.when(test, F.col("char_count")).otherwise(0)).alias("test_chars"),
        F.count_if(train).alias("train_speeches"),
        F.count_if(test).alias("test_speeches"),
    )


def author_fold_stats(speeches: DataFrame, folds: DataFrame) -> DataFrame:
    """id_person, fold_id, train/val characters and speeches."""
    rows = folds.select("id_speech", "fold_id", "fold_role").join(speeches.select("id_speech", "id_person", "char_count"), "id_speech")
    train, val = F.col("fold_role") == "train", F.col("fold_role") == "val"
    return rows.groupBy("id_person", "fold_id").agg(
        F.sum(F.when(train, F.col("char_count")).otherwise(0)).alias("train_chars"),
        F.sum(F.when(val, F.col("char_count")).otherwise(0)).alias("val_chars"),
        F.count_if(train).alias("train_speeches"),
        F.count_if(val).alias("val_speeches"),
    )


def covered_authors(fold_stats: DataFrame, k: int, least_train: int, least_val: int) -> DataFrame:
    """Authors with at least so many train and val characters in each of k folds."""
    sums = fold_stats.groupBy("id_person").agg(F.count(F.lit(1)).alias("folds"), F.min("train_chars").alias("least_train_chars"), F.min("val_chars").alias("least_val_chars"))
    return sums.filter((F.col("folds") == k) & (F.col("least_train_chars") >= least_train) & (F.col("least_val_chars") >= least_val))


def authors_in_all_elections(speeches: DataFrame, elections: list[int], least_chars: int) -> DataFrame:
    """Authors with at least so many characters in every one of the elections (relational division)."""
    each = speeches.filter(F.col("election").isin(elections)).groupBy("id_person", "election").agg(F.sum("char_count").alias("chars"))
    return (
        each.filter(F.col("chars") >= least_chars).groupBy("id_person").agg(F.count(F.lit(1)).alias("elections"), F.min("chars").alias("least_chars")).filter(F.col("elections") == len(set(elections)))
    )


def feasible_folds(folds: DataFrame, authors: DataFrame) -> DataFrame:
    """fold_id, authors with train and with val rows, feasible: whether all authors have both."""
    wanted = authors.select("id_person").distinct()
    have = folds.join(wanted, "id_person", "left_semi").groupBy("fold_id").agg(
        F.count_distinct(F.when(F.col("fold_role") == "train", F.col("id_person"))).alias("train_authors"),
        F.count_distinct(F.when(F.col("fold_role") == "val", F.col("id_person"))).alias("val_authors"),
    )
    number = wanted.agg(F.count(F.lit(1)).alias("n"))
    feasible = (F.col("train_authors") == F.col("n")) & (F.col("val_authors") == F.col("n"))
    return have.crossJoin(F.broadcast(number)).select("fold_id", "train_authors", "val_authors", feasible.alias("feasible"))  # number: one row


# selection of authors


def author_pool(speeches: DataFrame) -> DataFrame:
    """id_person, party (of the latest speech), total characters and speeches."""
    return speeches.groupBy("id_person").agg(
        F.max_by("party", F.struct(*ORDER)).alias("party"), F.sum("char_count").alias("total_chars"), F.count(F.lit(1)).alias("total_speeches")
    )


def with_party_rank(pool: DataFrame, metric: str = "total_chars") -> DataFrame:
    """Adds party_rank, by the metric within the party, ties by id."""
    return pool.withColumn("party_rank", F.row_number().over(Window.partitionBy("party").orderBy(F.desc(metric), "id_person")))


def select_top(pool: DataFrame, k: int, metric: str = "total_chars") -> DataFrame:
    return pool.orderBy(F.desc(metric), "id_person").limit(k)


def select_per_party(pool: DataFrame, k: int, metric: str = "total_chars") -> DataFrame:
    return with_party_rank(pool, metric).filter(F.col("party_rank") <= k)


def select_alternating(pool: DataFrame, k: int, metric: str = "total_chars") -> DataFrame:
    """The first k authors when parties, ordered by their best author, take turns."""
    ranked = with_party_rank(pool, metric).filter(F.col("party_rank") <= k)  # no party has more than k turns
    parties = pool.groupBy("party").agg(F.max(metric).alias("best"))
    turn = parties.select("party", F.row_number().over(Window.orderBy(F.desc("best"), "party")).alias("party_turn"))
    joined = ranked.join(turn, "party")
    place = F.row_number().over(Window.orderBy("party_rank", "party_turn"))  # over k authors of each party at most
    return joined.withColumn("place", place).filter(F.col("place") <= k).select("id_person", "party", metric, "place")


def select_with_party_minimum(pool: DataFrame, k: int, least: int, metric: str = "total_chars") -> DataFrame:
    """The top k, without parties that have fewer than ``least`` of them; others of the remaining parties fill up."""
    good = select_top(pool, k, metric).groupBy("party").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    kept = select_top(pool.join(good.select("party"), "party", "left_semi"), k, metric)
    place = F.row_number().over(Window.orderBy(F.desc(metric), "id_person"))  # over k authors at most
    return kept.select("id_person", "party", metric, place.alias("place"))


def without_authors(pool: DataFrame, excluded: DataFrame) -> DataFrame:
    """``pool`` without the authors whose id stands, however written, in ``excluded`` (id_person)."""
    names = excluded.select(canonical_id(F.col("id_person")).alias("_id")).filter("_id is not null").distinct()
    return pool.join(names, canonical_id(F.col("id_person")) == F.col("_id"), "left_anti")


def filtered_pool(pool: DataFrame, least: dict[str, int], among: dict[str, list[str]] | None = None) -> DataFrame:
    """The authors of ``pool`` whose values stand in the lists of ``among`` and whose groups, by each column of ``least``, keep that many authors.

    A group that falls takes authors out of others, which may fall in turn, so rounds go on until none does.  A null is a
    group like any other.  What is counted is a row for each group.
    """
    rows = pool
    for column, values in (among or {}).items():
        rows = rows.filter(F.col(column).isin(values))
    rows = stage(rows, "pool")
    n = rows.count()
    while least:
        kept = rows
        for column, k in least.items():
            groups = rows.groupBy(F.col(column).alias("_group")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select("_group")
            kept = kept.join(groups, F.col(column).eqNullSafe(F.col("_group")), "left_semi")
        rows = stage(kept, "pool")
        before, n = n, rows.count()
        if n == before:
            break
    return rows


def units(outer: DataFrame, folds: DataFrame, selector: str) -> DataFrame:
    """unit, eval_role, id_speech, id_person, role: what is materialised together, each fold (``all``) or the outer train and test rows (``final``)."""
    if selector == "all":
        return folds.select(F.col("fold_id").cast("string").alias("unit"), F.lit("val").alias("eval_role"), "id_speech", "id_person", F.col("fold_role").alias("role"))
    if selector == "final":
        return outer.filter(F.col("outer_role").isin("train", "test")).select(F.lit("final").alias("unit"), F.lit("test").alias("eval_role"), "id_speech", "id_person", F.col("outer_role").alias("role"))
    raise ValueError(f"selector {selector!r}: all or final")
