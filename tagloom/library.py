"""The tables of a tagged media library, cleaned, as one object that operators take.

Media and edges are cleaned once per state of their files and written into the shared folder: media by id, edges once by medium and once by tag, in
ranges of those keys. Queries read that with their filters and columns pushed into the scan, and row groups outside the ids asked for are skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import Scratch, table_state

#: Bytes of the source that one file of a cleaned table stands for, at most and at least.
FILE_BYTES, LEAST_BYTES = 128 << 20, 1 << 20
#: Ids that may stand in a filter as literals; more are joined.
LISTED_IDS = 1_000
#: What decides between two rows of one (media, tag), best first; also the columns an edge keeps.
EDGE_COLUMNS = ["updated_at", "created_at", "source", "confidence", "is_locked", "is_suggestion"]
MEDIA_COLUMNS = [
    "filename", "path", "hash", "file_type", "mime_type", "file_size", "width", "height", "duration", "rating", "uploaded_at", "source", "parent_id", "content_class", "content_class_confidence",
]


def latest_media(rows: DataFrame) -> DataFrame:
    """One row per id, the newest export. Spark sorts for this aggregate (its buffer holds strings), once for a state of the table."""
    best = F.max(F.struct("exported_at", *MEDIA_COLUMNS)).alias("row")
    return rows.filter("id is not null").groupBy("id").agg(best).select("id", *[F.col(f"row.{c}").alias(c) for c in MEDIA_COLUMNS])


def distinct_edges(rows: DataFrame) -> DataFrame:
    """One row per (media_id, tag_id), the one updated last; sorts, as above."""
    best = F.max(F.struct(*EDGE_COLUMNS)).alias("row")
    kept = rows.filter("media_id is not null and tag_id is not null").groupBy("media_id", "tag_id").agg(best)
    return kept.select("media_id", "tag_id", *[F.col(f"row.{c}").alias(c) for c in EDGE_COLUMNS])


#: Projections of the driver's star schema and of tags onto tables the test data lacks; plain SQL that both engines run. {x} is a table.
PROJECTIONS = {
    "albums": """select 1000000 + cast(r_regionkey as bigint) as id, r_name as name from {region}
        union all select 2000000 + cast(n_nationkey as bigint), n_name from {nation} union all select 3000000 + c_custkey, c_name from {customer}""",
    "album_hierarchy": """select 1000000 + cast(n_regionkey as bigint) as parent_album_id, 2000000 + cast(n_nationkey as bigint) as child_album_id from {nation}
        union all select 2000000 + cast(c_nationkey as bigint), 3000000 + c_custkey from {customer}""",
    "album_media": "select distinct 3000000 + o_custkey as album_id, o_orderkey as media_id from {orders}",
    "tag_aliases": """select concat('old_', name) as alias_name, id as target_tag_id from {tags} where id % 5 = 0
        union all select concat('alt_', name), id from {tags} where id % 15 = 0""",
    "name_aliases": """select concat('nick_', name) as a, concat('alt_', name) as b from {tags} where id % 15 = 0
        union all select concat('short_', name), concat('nick_', name) from {tags} where id % 30 = 0""",
    "implication_targets": """select id as rule_id, id as tag_id from {tags} where id % 7 = 0
        union all select id, id + 1 from {tags} where id % 21 = 0""",
    "implication_implied": "select id as rule_id, id + 2 as tag_id from {tags} where id % 7 = 0 union all select id, id + 5 from {tags} where id % 14 = 0",
    "tag_translations": """select name as canonical_name, 'zh' as language, concat('zh_', name) as display_name, concat('z', name) as alias, category,
        case id % 4 when 0 then 'manual' when 1 then 'static' when 2 then 'llm' else 'imported' end as source,
        case when id % 9 = 0 then 'rejected' when id % 3 = 0 then 'pending' else 'reviewed' end as status, id % 6 = 1 as needs_review from {tags} where id % 3 <> 2
        union all select name, 'zh', concat('zh2_', name), concat('z2', name), category, 'imported', 'reviewed', false from {tags} where id % 4 = 0""",
    "sync_items": """select user_id as path_id, cast(floor(value * 100) as bigint) as file_size, ts as mtime, event_id from {events}""",
}


class Prepared:
    """Cleaned tables of one folder and application, written on first use and again when the files they come from change."""

    _all: dict[tuple[str, str], Prepared] = {}

    def __init__(self, spark: SparkSession):
        self.scratch = Scratch(spark, "library")
        self.done: dict[str, tuple[str, DataFrame]] = {}  # by name: state of the source, written table

    @classmethod
    def of(cls, spark: SparkSession, folder: str) -> Prepared:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._all:
            cls._all[key] = cls(spark)
        return cls._all[key]

    def table(self, spark: SparkSession, name: str, source: str, make, *by: str) -> DataFrame:
        """The table ``make()`` gives, in files that are ranges of the columns ``by``."""
        state, size = table_state(spark, source)
        old = self.done.get(name)
        if old is None or old[0] != state:
            files = max(1, min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES), -(-size // FILE_BYTES))
            self.done[name] = (state, self.scratch.put(make().repartitionByRange(files, *by).sortWithinPartitions(*by)))
            if old is not None:
                self.scratch.drop(old[1])
        written = self.done[name][1]
        return spark.read.schema(written.schema).parquet(written._scratch_path)


@dataclass
class Library:
    """Cleaned tables. Raw ones are read by name from ``folder`` on first use; those ``given`` as frames are cleaned where they are used, not written."""

    spark: SparkSession
    folder: str
    given: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        self.framed = set(self.given)

    def raw(self, name: str) -> DataFrame:
        if name not in self.given:
            self.given[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.given[name]

    def prepared(self, name: str, source: str, make, *by: str) -> DataFrame:
        """What ``make()`` gives, written once for a state of the raw table ``source`` that it comes from, in ranges of the columns ``by``."""
        if source in self.framed:
            return make()
        return Prepared.of(self.spark, self.folder).table(self.spark, name, f"{self.folder}/{source}.parquet", make, *by)

    @cached_property
    def media(self) -> DataFrame:
        return self.prepared("media", "media", lambda: latest_media(self.raw("media")), "id")

    @property
    def tags(self) -> DataFrame:
        return self.raw("tags").select("id", "name", "category", "post_count", "created_at")

    @cached_property
    def edges(self) -> DataFrame:
        """Edges in ranges of media_id."""
        return self.prepared("edges", "media_tags", lambda: distinct_edges(self.raw("media_tags")), "media_id", "tag_id")

    @cached_property
    def edges_by_tag(self) -> DataFrame:
        """The same edges in ranges of tag_id."""
        return self.prepared("edges_by_tag", "media_tags", lambda: self.edges, "tag_id", "media_id")

    def edges_of(self, chosen: Column, *also: str) -> DataFrame:
        """(media_id, tag_id, is_suggestion, ...) of the edges of the tags a condition chooses, with the columns ``also`` of those tags.

        Up to ``LISTED_IDS`` ids go into the scan as literals, so that only their row groups are read; more are joined.
        """
        tags = self.tags.filter(chosen).select(F.col("id").alias("tag_id"), *also)
        ids = [r["tag_id"] for r in tags.select("tag_id").limit(LISTED_IDS + 1).collect()]
        return self._edges_in(tags, ids, bool(also))

    def edges_in(self, tags: DataFrame) -> DataFrame:
        """The same for the tags of a frame (tag_id)."""
        return self._edges_in(tags, [r["tag_id"] for r in tags.select("tag_id").limit(LISTED_IDS + 1).collect()], False)

    def _edges_in(self, tags: DataFrame, ids: list[int], also: bool) -> DataFrame:
        edges = self.edges_by_tag.select("media_id", "tag_id", "is_suggestion")
        if len(ids) <= LISTED_IDS:
            edges = edges.filter(F.col("tag_id").isin(ids))
            return edges.join(F.broadcast(tags), "tag_id") if also else edges
        return edges.join(tags, "tag_id", "inner" if also else "left_semi")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in PROJECTIONS:
            raise AttributeError(name)
        text = PROJECTIONS[name]
        used = {t: self.raw(t) for t in ("region", "nation", "customer", "orders", "events", "tags") if "{" + t + "}" in text}
        made = self.spark.sql(text, **used)
        self.__dict__[name] = made
        return made


# The same tables for the oracle, as common table expressions.
_MEDIA_SQL = ", ".join(MEDIA_COLUMNS)
_EDGE_SQL = ", ".join(EDGE_COLUMNS)
_EDGE_ORDER = ", ".join(f"{c} desc nulls last" for c in EDGE_COLUMNS)


def oracle(body: str, *ctes: str, recursive: bool = False) -> str:
    """SQL over the cleaned tables m (media), t (tags), e (edges) and the projections."""
    tables = [
        f"m as (select id, {_MEDIA_SQL} from (select *, row_number() over (partition by id order by exported_at desc) as rn from media) where rn = 1)",
        "t as (select id, name, category, post_count, created_at from tags)",
        f"e as (select media_id, tag_id, {_EDGE_SQL} from (select *, row_number() over (partition by media_id, tag_id order by {_EDGE_ORDER}) as rn from media_tags where media_id is not null and tag_id is not null) where rn = 1)",
        *(f"{k} as ({v.replace('{', '').replace('}', '')})" for k, v in PROJECTIONS.items()),
    ]
    return f"with {'recursive ' * recursive}{', '.join([*tables, *ctes])} {body}"
