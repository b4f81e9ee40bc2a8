"""Similar headline pairs without comparing everything with everything.

Works on *groups*: one row per distinct headline profile and time bucket, so copies
are counted once. A pair scoring at least ``threshold`` shares at least
``ceil(threshold * n)`` of the shorter side's n tokens, whichever measure gave the score.
Among the shorter side's ``n - o + 2`` rarest tokens two must therefore be shared.
That gives the join keys:

* a token found in few groups of any one time bucket is a key of its own;
* hot tokens, found in many groups of a bucket, are refined. Their keys are the first tokens two
  headlines share, rarest first: one token to begin with, and where more than ``hot`` headlines are
  found under a key, the next shared token is added. That goes on until the list is short, or no
  token is left that a pair would still need, or all the tokens a pair must share are in the key.
  So only headlines that really share enough words meet in a long list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirefold.functions import text
from wirefold.operators.greedy import cut

HOT_TOKEN_GROUPS = 150


def rank_tokens(groups: DataFrame, hot: int) -> DataFrame:
    """(pid, ranked): each profile's tokens rarest first, hot ones flagged.

    A token's weight is how many groups of one bucket that may be the earlier side have it at most, since
    that is how many candidates it gives a headline. The undated, all in one bucket, are the later side only.
    """
    exploded = groups.select("pid", "bucket", "as_old", F.explode("profile.tokens").alias("token"))
    df = (exploded.groupBy("token", "bucket").agg(F.count_if("as_old").alias("n"))
          .groupBy("token").agg(F.max("n").alias("df")))
    return (exploded.select("pid", "token").distinct().join(df, "token").groupBy("pid")
            .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
            .select("pid", F.transform("r", lambda t: F.struct(
                t["token"].alias("token"), (t["df"] > hot).alias("hot"))).alias("ranked")))


def overlap_needed(n: Column, threshold: float) -> Column:
    return F.ceil(n * threshold - 1e-9).cast("int")


def _cold_keys(ranked: Column, threshold: float, small: bool) -> Column:
    """array<struct(key, pos)>: the rare tokens a headline is looked up by, or can be found under."""
    n = F.size(ranked)
    scope = F.slice(ranked, 1, n - overlap_needed(n, threshold) + 2) if small else ranked
    at = F.transform(scope, lambda t, i: F.struct(
        t["token"].alias("key"), i.alias("pos"), t["hot"].alias("hot")))
    return F.transform(F.filter(at, lambda t: ~t["hot"]),
                       lambda t: F.struct(t["key"].alias("key"), t["pos"].alias("pos")))


LIST = ["key", "numbers", "bucket", "role"]


def _role(asked: bool) -> Column:
    """What a group may be to another, as part of the key, so that two that are both only the later side (all
    undated ones), or both only the earlier, never meet: its own role, or those it asks for."""
    both, new = F.col("as_new") & F.col("as_old"), F.col("as_new")
    if not asked:
        return F.when(both, "both").when(new, "new").otherwise("old")
    return F.explode(F.when(both, F.array(F.lit("both"), F.lit("new"), F.lit("old")))
                     .when(new, F.array(F.lit("both"), F.lit("old"))).otherwise(F.array(F.lit("both"), F.lit("new"))))


def _from(first: Column, last: Column) -> Column:
    """The positions first..last, none if there are none."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _refined(wide: DataFrame, threshold: float, hot: int) -> DataFrame | None:
    """(s, l) candidate rows whose first shared token is a hot one; None without any.

    Position p of the shorter side can hold the j-th shared token only up to n - need + j - 1, as the
    ones still needed come after it.
    """
    n, cold = F.size("tokens"), F.size(F.filter("ranked", lambda t: ~t["hot"]))
    rows = (wide.withColumn("tokens", F.transform("ranked", lambda t: t["token"])).withColumn("cold", cold)
            .where(F.col("cold") < n))
    held = ["gid", "cls", "numbers", "as_new", "as_old", "bucket", "tokens"]

    def begin(df: DataFrame, last: Column) -> DataFrame:
        return (df.withColumn("pos", F.explode(_from(F.col("cold"), last)))
                .withColumn("key", F.get("tokens", F.col("pos"))).drop("cold"))

    def go_on(df: DataFrame, last: Column) -> DataFrame:
        return (df.withColumn("pos", F.explode(_from(F.col("pos") + 1, last)))
                .withColumn("key", F.concat_ws(" ", "key", F.get("tokens", F.col("pos")))))
    need = overlap_needed(n, threshold)
    s = begin(rows.select(*held, "cold", need.alias("need"), _role(True).alias("role")), n - F.col("need"))
    l = begin(rows.select(*held, "cold", _role(False).alias("role")), n - 1).withColumn("bucket", F.explode(F.array(
        F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)))
    level, found = 1, None
    while True:
        s = cut(s, "story-hot")
        if s.isEmpty():
            return found
        l = cut(l.join(s.select(*LIST).distinct(), LIST, "left_semi"), "story-hot-lists")
        lists = l.groupBy(*LIST).agg(F.count(F.lit(1)).alias("held"))
        s = cut(s.join(lists, LIST), "story-hot-asked")
        done = (F.col("held") <= hot) | (F.col("need") <= level)
        met = (s.where(done).alias("s").join(l.alias("l"), LIST)
               .where(F.size("l.tokens") - F.col("l.pos") > F.col("s.need") - level)
               .select("s.gid", "s.cls", "s.as_new", "s.as_old", F.size("s.tokens").alias("n"),
                       F.struct("l.gid", "l.cls", "l.as_new", "l.as_old",
                                F.size("l.tokens").alias("n")).alias("l")))
        found = met if found is None else found.unionByName(met)
        more = s.where(~done).drop("held")
        s = go_on(more, n - F.col("need") + level)
        l = go_on(l.join(more.select(*LIST).distinct(), LIST, "left_semi"), n - 1)
        level += 1


def _may_match(s: str, l: str, threshold: float) -> Column:
    """The shorter side and the longer one are of a size, of two classes, and one may be the earlier."""
    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")
    fits = (of(s, "n") >= text.MIN_TOKENS_FOR_CONTAINMENT) | (of(s, "n") >= of(l, "n") * threshold - 1e-9)
    shorter = (of(s, "n") < of(l, "n")) | ((of(s, "n") == of(l, "n")) & (of(s, "gid") < of(l, "gid")))
    useful = (of(s, "as_new") & of(l, "as_old")) | (of(l, "as_new") & of(s, "as_old"))
    return shorter & fits & useful & (of(s, "cls") != of(l, "cls"))


def similar_groups(groups: DataFrame, threshold: float,
                   hot: int = HOT_TOKEN_GROUPS) -> DataFrame:
    """Directed pairs (newer, older, score) among groups whose headlines match.

    ``groups(gid, pid, cls, profile, numbers, bucket, as_new, as_old)``: only groups
    flagged ``as_new`` are the later side, only ``as_old`` ones the earlier. Pairs of
    one class, of differing numbers or more than one bucket apart are left out.
    """
    wide = cut(groups.select("gid", "pid", "cls", "numbers", "bucket", "as_new", "as_old").join(
        rank_tokens(groups, hot), "pid").where(F.size("ranked") >= 2), "story-ranked")
    n = F.size("ranked")
    base = ["gid", "cls", "numbers", "as_new", "as_old", n.alias("n")]
    small = wide.select(
        *base, "bucket", overlap_needed(n, threshold).alias("need"),
        F.exists(F.slice("ranked", 1, n - overlap_needed(n, threshold) + 2),
                 lambda t: t["hot"]).alias("has_hot"),
        F.explode(_cold_keys(F.col("ranked"), threshold, True)).alias("k")).withColumn("role", _role(True))
    large = (wide.select(*base, "bucket", _role(False).alias("role"), F.explode(
                 _cold_keys(F.col("ranked"), threshold, False)).alias("k"))
             .withColumn("bucket", F.explode(F.array(
                 F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1))))
    s, l = small.alias("s"), large.alias("l")
    # From the second shared token on, all but one of the needed tokens are still to come.
    room = F.col("l.n") - F.col("l.k.pos") >= F.col("s.need") - 1
    candidates = (s.join(l, (F.col("s.k.key") == F.col("l.k.key"))
                         & (F.col("s.numbers") == F.col("l.numbers"))
                         & (F.col("s.bucket") == F.col("l.bucket")) & (F.col("s.role") == F.col("l.role"))
                         & _may_match("s", "l", threshold) & room)
                  .groupBy(F.col("s.gid").alias("a"), F.col("l.gid").alias("b"))
                  .agg(F.count("*").alias("shared"), F.first("s.has_hot").alias("has_hot"))
                  .where("shared >= 2 or has_hot").select("a", "b"))
    refined = _refined(wide, threshold, hot)
    if refined is not None:
        met = refined.alias("s").where(_may_match("s", "l", threshold))
        candidates = candidates.unionByName(
            met.select(F.col("gid").alias("a"), F.col("l.gid").alias("b"))).distinct()
    side = groups.select("gid", "profile", "as_new", "as_old")
    pair = (candidates
            .join(side.select(F.col("gid").alias("a"), F.struct(*side.columns).alias("ga")), "a")
            .join(side.select(F.col("gid").alias("b"), F.struct(*side.columns).alias("gb")), "b"))
    ways = F.array(F.struct(F.col("ga").alias("new"), F.col("gb").alias("old")),
                   F.struct(F.col("gb").alias("new"), F.col("ga").alias("old")))
    return (pair.select(F.explode(ways).alias("w"))
            .where("w.new.as_new and w.old.as_old")
            .select(F.col("w.new.gid").alias("newer"), F.col("w.old.gid").alias("older"),
                    text.profile_similarity(F.col("w.new.profile"),
                                            F.col("w.old.profile")).alias("score"))
            .where(F.col("score") >= threshold))
