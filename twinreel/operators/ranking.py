"""Best members, keepers, selections, statistics and orders of duplicate groups.

Rows carry group_id and pos, the order in which they were found: every "first" means least pos.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S



def _group():
    return Window.partitionBy("group_id")


#: Rows that a task sorts at once, some 100 MB of them: partitions grow in number, not in size.
ROWS_AT_ONCE = 500_000


def dealt(rows: DataFrame) -> DataFrame:
    """rows by group, in partitions whose size does not grow with the table."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-rows.count() // ROWS_AT_ONCE)), "group_id")


STRATEGIES = ("lowest_quality", "smallest_file", "shortest_duration", "worst_resolution", "hundred_percent_only")
#: Metrics of which the greatest is best; of size the smallest is. Images have only size and frame size.
BEST_MAX = {"duration": False, "fps": False, "bitrate": False, "audio_sample_rate": False, "audio_bitrate": False, "hdr_rank": False, "frame_size": True}


@dataclass(frozen=True)
class Criterion:
    """A ranking key: its column, direction, and whether images skip it."""

    column: str
    descending: bool = True
    video_only: bool = False

    def key(self) -> Column:
        value = F.when(~F.col("is_image"), F.col(self.column)) if self.video_only else F.col(self.column)
        return value.desc_nulls_last() if self.descending else value.asc_nulls_last()


#: The named criteria ("audio_bitrate" ranks by sample rate).
CRITERIA = {
    "duration": Criterion("duration", video_only=True), "resolution": Criterion("frame_size"), "fps": Criterion("fps", video_only=True),
    "bitrate": Criterion("bitrate", video_only=True), "audio_bitrate": Criterion("audio_sample_rate", video_only=True), "size": Criterion("size", descending=False),
}
WEB_CRITERIA = ("duration", "resolution", "bitrate", "fps", "audio_bitrate", "size")
GUI_CRITERIA = ("duration", "resolution", "fps", "bitrate", "audio_bitrate", "size")


def resolved_criteria(names: list[str]) -> list[Criterion]:
    """The named criteria in their order, then the rest in the usual one; unknown names go."""
    return [CRITERIA[n] for n in dict.fromkeys([*names, *GUI_CRITERIA]) if n in CRITERIA]


def with_best_flags(rows: DataFrame) -> DataFrame:
    """best_<metric>: equals the best of the group (ties all are)."""
    out = rows.withColumn("best_size", F.col("size") == F.min("size").over(_group()))
    for metric, images in BEST_MAX.items():
        if metric in rows.columns:
            best = F.col(metric) == F.max(metric).over(_group())
            out = out.withColumn(f"best_{metric}", best if images else best & ~F.col("is_image"))
    return out


def keepers(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows with keeper: the first of its group by the keys, then by pos."""
    return rows.withColumn("keeper", F.row_number().over(_group().orderBy(*keys, "pos")) == 1)


def to_delete(rows: DataFrame, strategy: str) -> DataFrame:
    """Rows that a strategy gives up; names say what goes. Groups of one row lose nothing."""
    keys = {
        "smallest_file": [F.desc("size")], "shortest_duration": [F.desc("duration")], "worst_resolution": [F.desc("frame_size")],
    }.get(strategy, [F.desc("best_bitrate"), F.desc("best_frame_size")])
    if strategy not in ("smallest_file", "shortest_duration", "worst_resolution"):
        any_rate, any_frame = F.bool_or("best_bitrate").over(_group()), F.bool_or("best_frame_size").over(_group())
        rows = rows.withColumn("rate_", any_rate).withColumn("frame_", any_frame)
        plain = lambda c: F.when(~F.col("rate_") & ~F.col("frame_"), F.col(c))
        keys = [F.when(F.col("rate_"), F.col("best_bitrate")).desc(), F.when(~F.col("rate_"), F.col("best_frame_size")).desc(),
                plain("bitrate").desc(), plain("frame_size").desc(), plain("size").desc()]
    out = keepers(rows, keys).withColumn("n_", F.count("*").over(_group())).withColumn("low_", F.min("similarity").over(_group()))
    keep = (F.col("n_") >= 2) & ~F.col("keeper")
    if strategy == "hundred_percent_only":
        keep = keep & (F.col("low_") >= 100)
    return out.filter(keep).drop("rate_", "frame_", "n_", "low_", "keeper")


def check_lowest_quality(rows: DataFrame, names: list[str]) -> DataFrame:
    """checked: all but the best by the criteria in order."""
    out = keepers(rows, [c.key() for c in resolved_criteria(names)])
    return out.withColumn("checked", ~F.col("keeper")).drop("keeper")


def check_by_order(rows: DataFrame, *keys: Column) -> DataFrame:
    """checked: all but the first by the keys (oldest, newest, smallest ...)."""
    return keepers(rows, list(keys)).withColumn("checked", ~F.col("keeper")).drop("keeper")


_FACTS = ["duration", "frame_size", "format", "audio_format", "audio_channel", "audio_sample_rate", "bitrate", "fps"]
#: Columns in which rows of a group must agree (nulls agree) to be identical at a level.
IDENTITY = {"full": ["size", *_FACTS], "but_size": _FACTS, "but_quality": [], "length": ["duration"]}


def check_identical(rows: DataFrame, level: str = "full") -> DataFrame:
    """checked: later rows of the first set of identical rows of each group, one set a group."""
    same = Window.partitionBy("group_id", *IDENTITY[level])
    out = rows.withColumn("n_", F.count("*").over(same)).withColumn("first_", F.min("pos").over(same))
    out = out.withColumn("set_", F.min(F.when(F.col("n_") > 1, F.col("first_"))).over(_group()))
    hit = (F.col("n_") > 1) & (F.col("first_") == F.col("set_")) & (F.col("pos") != F.col("first_"))
    return out.withColumn("checked", F.coalesce(hit, F.lit(False))).drop("n_", "first_", "set_")


def check_hundred_percent(rows: DataFrame) -> DataFrame:
    """checked: all but the first in groups in which all are 100 % similar."""
    whole = F.bool_and(F.col("similarity") >= 100).over(_group())
    return rows.withColumn("checked", whole & (F.row_number().over(_group().orderBy("pos")) > 1))


def custom_selection(rows: DataFrame, identity: int = 0, date_order: int = 0) -> DataFrame:
    """rows with checked after a custom selection over those given (filtered before).

    Of each group the first row's set counts: the rows of its group (0), those identical to it in
    full (1) or but for the size (2). All of a set are checked; by rising (1) or falling (2) date
    the foremost is spared, unless it is the group's first row, which stands in its set twice.
    Mode 3 takes what differs from a group's first row, whatever its group, so with several groups
    every row is checked (dates are not read there). Rows outside of any set keep their mark.
    """
    held = F.coalesce("checked", F.lit(False))
    keys = {0: [], 1: IDENTITY["full"], 2: IDENTITY["but_size"], 3: IDENTITY["full"]}[identity]
    lead = F.first(F.struct(*keys, F.col("pos").alias("pos_"))).over(_group().orderBy("pos"))
    out = rows.withColumn("lead_", lead)
    same, leads = F.lit(True), F.col("pos") == F.col("lead_.pos_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"lead_.{k}"))
    if identity == 3:
        several = rows.agg((F.min("group_id") != F.max("group_id")).alias("several_"))
        out = out.join(F.broadcast(several))
        return out.withColumn("checked", F.when(F.col("several_") | leads | ~same, True).otherwise(held)).drop("lead_", "several_")
    out = out.withColumn("in_", same).withColumn("leads_", leads)
    spared = F.lit(False)
    if date_order:
        date = F.asc("date_created") if date_order == 1 else F.desc("date_created")
        place = F.row_number().over(Window.partitionBy("group_id", "in_").orderBy(date, F.desc("leads_"), "pos"))
        spared = (place == 1) & ~F.col("leads_")
    return out.withColumn("checked", F.when(F.col("in_"), ~spared).otherwise(held)).drop("lead_", "in_", "leads_")


AUTO_MODES = ("lowest_quality", "smallest_file", "oldest", "newest", "hundred_percent")


def auto_select(rows: DataFrame, mode: str) -> DataFrame:
    """checked by one of the named modes: what is kept is the best, largest, newest, oldest or
    first row."""
    if mode == "lowest_quality":
        keys = [c.key() for c in (CRITERIA[n] for n in WEB_CRITERIA)]
    elif mode == "hundred_percent":
        return check_hundred_percent(rows)
    else:
        keys = {"smallest_file": [F.desc("size")], "oldest": [F.desc("date_created")], "newest": [F.asc("date_created")]}[mode]
    return check_by_order(rows, *keys)


def keep_best_in_group(rows: DataFrame, group: Column, names: list[str]) -> DataFrame:
    """checked in the groups that a condition picks: all but the best; elsewhere as before."""
    out = keepers(rows, [c.key() for c in resolved_criteria(names)])
    return out.withColumn("checked", F.when(group, ~F.col("keeper")).otherwise(F.col("checked"))).drop("keeper")


def keep_rows(rows: DataFrame, kept: Column) -> DataFrame:
    """checked in groups with a kept row: all but the kept ones; elsewhere as before."""
    any_kept = F.max(F.col("k_").cast("int")).over(_group()) == 1
    out = rows.withColumn("k_", F.coalesce(kept, F.lit(False)))
    return out.withColumn("checked", F.when(any_kept, ~F.col("k_")).otherwise(F.col("checked"))).drop("k_")


def scoped(rows: DataFrame, highlighted: Column) -> DataFrame:
    """The highlighted rows if there are several, else all."""
    n = rows.agg(F.count_if(highlighted).alias("n_"))
    return rows.withColumn("h_", highlighted).join(F.broadcast(n)).filter((F.col("n_") < 2) | F.col("h_")).drop("h_", "n_")


def group_headers(rows: DataFrame) -> DataFrame:
    """For each group: rows, checked and hidden ones, whether all are checked, best similarity, size."""
    return rows.groupBy("group_id").agg(
        F.count("*").alias("n"), F.count_if("checked").alias("n_checked"), F.count_if(~F.col("visible")).alias("n_hidden"),
        F.bool_and("checked").alias("whole"), F.max("similarity").alias("best_similarity"), F.sum(F.greatest("size", F.lit(0))).alias("total_size"),
    )


def selected_size(rows: DataFrame) -> DataFrame:
    """Statistics over the visible groups: groups, rows, bytes, what could be saved, what is checked."""
    size = F.greatest("size", F.lit(0))
    per = rows.groupBy("group_id").agg(F.count("*").alias("n"), F.sum(size).alias("total"), F.max(size).alias("largest"), F.sum(F.when(F.col("checked"), size).otherwise(0)).alias("picked"))
    return per.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_items"), F.sum("total").alias("total_size"), F.sum(F.col("total") - F.col("largest")).alias("savings"), F.sum("picked").alias("selected_size"))


WITHIN_GROUP = {
    "similarity": ("similarity", False), "size": ("size", False), "duration": ("duration", False), "bitrate": ("bitrate", False),
    "resolution": ("frame_size", False), "date": ("date_created", False), "name": ("name", True),
}


def places_in_group(sort: str, name: str | None = None) -> Column:
    """A row's place in its group by one of the named sorts, from 1. name: a column that has the
    last part of the path."""
    column, rising = WITHIN_GROUP.get(sort, WITHIN_GROUP["similarity"])
    value = F.element_at(F.split("path", "/"), -1) if column == "name" and not name else F.col(name if column == "name" else column)
    return F.row_number().over(_group().orderBy(value.asc() if rising else value.desc(), "pos"))


def inverted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("checked", ~F.col("checked"))


def without_singletons(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_", F.count("*").over(_group())).filter("n_ > 1").drop("n_")


def without_hard_links(rows: DataFrame) -> DataFrame:
    """The first of each file (device, inode, size) in a group."""
    of = Window.partitionBy("group_id", "size", "dev", "ino").orderBy("pos")
    return rows.withColumn("r_", F.row_number().over(of)).filter("r_ = 1").drop("r_")


def group_statistics(rows: DataFrame) -> DataFrame:
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_groups"), F.sum("n").alias("n_items"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("max_size"),
        F.count_if(F.col("n") > 5).alias("over_5"), F.count_if(F.col("n") > 10).alias("over_10"),
    )


def savings(rows: DataFrame) -> DataFrame:
    """All bytes, and those beyond the largest file of each group; negative sizes count 0."""
    size = F.greatest("size", F.lit(0))
    per = rows.groupBy("group_id").agg(F.sum(size).alias("total"), F.max(size).alias("largest"))
    return per.agg(F.sum("total").alias("total_size"), F.sum(F.col("total") - F.col("largest")).alias("savings"))


def relative_to_best(rows: DataFrame, metric: str, smallest: bool = False) -> DataFrame:
    """diff_text: "best", or the difference to the group's best in percent; where the smallest is
    best, exact halves go to the even number."""
    best = (F.min(metric) if smallest else F.max(metric)).over(_group())
    percent = F.try_divide((F.col(metric) - best).cast("double"), best) * 100
    return rows.withColumn("diff_text", F.when(F.col(metric) == best, "best").when(best > 0, S.percent_diff_text(percent, half_even=smallest)))


def relative_duration(rows: DataFrame) -> DataFrame:
    gap = F.col("duration") - F.max("duration").over(_group())
    return rows.withColumn("diff_text", F.when(gap == 0, "best").otherwise(S.duration_diff_text(gap)))


def group_navigation(rows: DataFrame) -> DataFrame:
    """group_id, next_group, previous_group, around the ends: neighbours are those whose places
    in the order are one apart."""
    from ..sources.tables import cut

    groups = cut(ordinals(rows.select("group_id").distinct(), [F.asc("group_id")], "at"))
    n = groups.agg(F.count("*").alias("n_"))
    placed = groups.join(F.broadcast(n))
    ring = lambda step: F.pmod(F.col("at") + step, F.col("n_"))
    other = lambda name: groups.select(F.col("at").alias(f"at_{name}"), F.col("group_id").alias(name))
    out = placed.withColumn("at_next_group", ring(1)).withColumn("at_previous_group", ring(-1))
    return out.join(other("next_group"), "at_next_group").join(other("previous_group"), "at_previous_group").select("group_id", "next_group", "previous_group")


def ordinals(rows: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """rows with their place in a total order, from 0: ranges are sorted by themselves and written
    in that order with each row's number in its range, so rows move once; only the ranges' sizes
    (a row for each partition) are added up in one task."""
    from ..sources.tables import cut

    # part_: the partition's number and, in its last 33 bits, the row's number there
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.monotonically_increasing_id()))
    place = F.col("part_").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("place_", place).withColumn("part_", F.shiftright("part_", 33))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part_").agg(F.count("*").alias("n_")).withColumn("start_", F.coalesce(F.sum("n_").over(before), F.lit(0)))
    return dealt.join(F.broadcast(starts.drop("n_")), "part_").withColumn(name, (F.col("start_") + F.col("place_")).cast("long")).drop("part_", "start_", "place_")


def sort_keys(order: str, ascending: bool = True) -> tuple[dict[str, Column], list[Column]]:
    """The named orders: helper columns over groups, and the keys to order by."""
    helpers = {"group_size": F.count("*").over(_group()), "group_total": F.sum("size").over(_group()), "group_checked": F.max(F.col("checked").cast("int")).over(_group())}
    names = {"size": "size", "resolution": "frame_size", "duration": "duration", "date": "date_created", "similarity": "similarity",
             "group_checked": "group_checked", "group_size": "group_size", "group_total": "group_total"}
    column = names[order]
    return ({column: helpers[column]} if column in helpers else {}), [F.asc(column) if ascending else F.desc(column), F.asc("group_id"), F.asc("pos")]


def sorted_rows(rows: DataFrame, order: str, ascending: bool = True) -> DataFrame:
    helpers, keys = sort_keys(order, ascending)
    return rows.withColumns(helpers).orderBy(*keys) if helpers else rows.orderBy(*keys)


def first_claims(matches: DataFrame, order: str = "source") -> DataFrame:
    """Each clip at the first source that has it; the group is the source."""
    of = Window.partitionBy("clip").orderBy(order)
    return matches.withColumn("r_", F.row_number().over(of)).filter("r_ = 1").drop("r_").withColumn("group_id", F.col("source"))


def clip_rows(claims: DataFrame) -> DataFrame:
    """group_id, member, difference, flags, at: each source once, and its clips."""
    sources = claims.select("group_id", F.col("source").alias("member"), F.lit(0.0).alias("difference"), F.lit(0).alias("flags"), F.lit(0).alias("at")).distinct()
    return sources.unionByName(
        claims.select("group_id", F.col("clip").alias("member"), (1 - F.col("similarity")).alias("difference"), F.lit(2).alias("flags"), "at")
    )
