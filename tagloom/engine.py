"""The query surface: one object over a library that answers what the reference's endpoints answer, as DataFrames.

Every method is a lazy plan but for the totals of pages. Results are ordered by a ``position`` column where order matters.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.library import Library
from tagloom.operators import albums as A, graph, soft_search, stats
from tagloom.plans import search as S, search_language as L

_SORTS = {
    "filename": ("filename", True), "file_size": ("file_size", False), "file_type": ("file_type", True), "uploaded_at": ("uploaded_at", False), "name": ("name", True),
}


@dataclass(frozen=True)
class Page:
    """Rows of a page with the numbers a caller shows beside it."""

    items: DataFrame
    total: int
    page: int
    pages: int


@dataclass
class Engine:
    lib: Library
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    aliases: dict[str, str] = field(default_factory=dict)

    def _page(self, found: DataFrame, keys, page: int, limit: int) -> Page:
        total = found.count()
        return Page(S.page(found, keys, limit, page), total, page, max(1, -(-total // limit)))

    def _sort(self, sort: str | None, descending: bool | None):
        column, up = _SORTS.get(sort or "uploaded_at", ("uploaded_at", False))
        up = up if descending is None else not descending
        return [F.col(column).asc_nulls_last() if up else F.col(column).desc_nulls_first(), F.col("id").desc()]

    # Search

    def found(self, q: str, mode: str = "soft", rating: str | None = None, content_class: str | None = None) -> DataFrame:
        """Media of a query. Soft: each plain term also matches source names, tags and concepts; strict: tag names only."""
        query = L.parse(q, self.aliases)
        if mode == "strict":
            return S.select(self.lib, query, self.now, rating, content_class)
        include, exclude = query.include, query.exclude
        query.include, query.exclude = [], []
        media = S.select(self.lib, query, self.now, rating, content_class)
        hits = soft_search.search(self.lib, include, exclude).select(F.col("id").alias("__hit"))
        return media.join(hits, media["id"] == hits["__hit"], "left_semi") if include or exclude else media

    def search(self, q: str, mode: str = "soft", rating: str | None = None, content_class: str | None = None, sort: str | None = None, page: int = 1, limit: int = 30) -> Page:
        """One page; an order in the query beats the request's sort."""
        return self._page(self.found(q, mode, rating, content_class), self.keys(q, sort), page, limit)

    def keys(self, q: str, sort: str | None = None) -> list:
        """The sort keys of a request."""
        query = L.parse(q, self.aliases)
        ordered = "order" in query.meta or "sort" in query.meta
        if ordered:
            return S.order(query)
        return self._sort(sort or "uploaded_at", None) if sort else S.order(query, "uploaded_at")

    def random(self, q: str, seed: int, mode: str = "soft") -> DataFrame:
        """One medium of a query, drawn by a seed."""
        return self.found(q, mode).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(1)

    def count(self, q: str) -> int:
        return self.found(q, "strict").count()

    def posts(self, q: str, page: int = 1, limit: int = 100) -> DataFrame:
        """Posts in the compatible form, with tag strings."""
        query = L.parse(q, self.aliases)
        return S.posts_page(S.page(S.select(self.lib, query, self.now), S.order(query), limit, page), self.lib)

    # Media

    def media_list(self, rating: str | None = None, sort: str | None = None, descending: bool | None = None, page: int = 1, limit: int = 30) -> Page:
        return self._page(self.lib.media.filter(S.ceiling(rating, listing=True)), self._sort(sort, descending), page, limit)

    def media_batch(self, ids: list[int]) -> DataFrame:
        return self.lib.media.filter(F.col("id").isin(ids))

    def media_detail(self, media_id: int) -> DataFrame:
        """One medium with its parent's other children, its children and its tags with their provenance."""
        me = self.lib.media.filter(F.col("id") == media_id)
        kin = self.lib.media.select(F.col("id").alias("kin"), F.col("parent_id").alias("of")).filter("of is not null")
        kids = kin.filter(F.col("of") == media_id).agg(F.sort_array(F.collect_list("kin")).alias("children")).withColumn("id", F.lit(media_id).cast("bigint"))
        sibs = me.select("id", "parent_id").join(kin, F.col("parent_id") == F.col("of")).filter("kin <> id").groupBy("id").agg(F.sort_array(F.collect_list("kin")).alias("siblings"))
        tags = self.lib.edges.filter(F.col("media_id") == media_id).join(self.lib.tags.select(F.col("id").alias("tag_id"), "name", "category"), "tag_id")
        listed = tags.groupBy(F.col("media_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("name", "category", "source", "confidence", "is_locked", "is_suggestion"))).alias("tags"))
        return me.join(kids, "id", "left").join(sibs, "id", "left").join(listed, "id", "left")

    def media_albums(self, media_id: int) -> DataFrame:
        ids = self.lib.album_media.filter(F.col("media_id") == media_id).select(F.col("album_id").alias("id"))
        return self.lib.albums.join(ids, "id", "left_semi")

    def shared(self, share_key: str) -> DataFrame:
        """The medium of a share key."""
        return self.lib.media.filter(F.md5(F.concat(F.lit("share:"), F.col("id").cast("string"))) == share_key)

    # Albums

    def albums(self, roots: bool = False, page: int = 1, limit: int = 30) -> Page:
        rows = self.lib.albums
        if roots:
            rows = rows.join(self.lib.album_hierarchy, rows["id"] == self.lib.album_hierarchy["child_album_id"], "left_anti")
        return self._page(rows, [F.asc("name"), F.asc("id")], page, limit)

    def album_contents(self, album_id: int, q: str = "", page: int = 1, limit: int = 30) -> Page:
        """Media of one album that a strict query names."""
        ids = self.lib.album_media.filter(F.col("album_id") == album_id).select(F.col("media_id").alias("id"))
        query = L.parse(q, self.aliases)
        return self._page(S.select(self.lib, query, self.now).join(ids, "id", "left_semi"), S.order(query), page, limit)

    def album_tags(self, album_id: int, k: int = 20) -> DataFrame:
        return A.popular_tags(self.lib, k).filter(F.col("top") == album_id)

    def album_children(self, album_id: int) -> DataFrame:
        kids = self.lib.album_hierarchy.filter(F.col("parent_album_id") == album_id).select(F.col("child_album_id").alias("id"))
        return self.lib.albums.join(kids, "id", "left_semi")

    def album_parents(self, album_id: int) -> DataFrame:
        """(node, root, depth, path) of one album."""
        edges = self.lib.album_hierarchy.select(F.col("parent_album_id").alias("parent"), F.col("child_album_id").alias("child"))
        return graph.breadcrumbs(edges).filter(F.col("node") == album_id)

    # Tags

    def tags(self, contains: str = "", category: str | None = None, names: list[str] | None = None, hide_empty: bool = False, limit: int = 100) -> DataFrame:
        rows = self.lib.tags
        if names is not None:
            order = F.array_position(F.array(*map(F.lit, names)), F.col("name"))
            return rows.filter(F.col("name").isin(names)).orderBy(order)
        if contains:
            rows = rows.filter(soft_search.like(F.col("name"), contains))
        if category:
            rows = rows.filter(F.col("category") == category)
        return (rows.filter("post_count > 0") if hide_empty else rows).orderBy(F.desc("post_count"), "id").limit(limit)

    def autocomplete(self, prefix: str, limit: int = 10) -> DataFrame:
        """Names that start with a text before names that contain it, then targets of aliases that start with it; each tag once."""
        name = F.lower("name")
        own = self.lib.tags.filter(F.contains(name, F.lit(prefix.lower()))).select("id", "name", "post_count", F.when(F.startswith(name, F.lit(prefix.lower())), 1).otherwise(2).alias("how"))
        alias = self.lib.tag_aliases.filter(F.startswith(F.lower("alias_name"), F.lit(prefix.lower()))).select(F.col("target_tag_id").alias("id")).join(self.lib.tags.select("id", "name", "post_count"), "id").withColumn("how", F.lit(3))
        best = own.unionByName(alias).groupBy("id", "name", "post_count").agg(F.min("how").alias("how"))
        return best.orderBy("how", F.desc("post_count"), "id").limit(limit)

    def related(self, names: list[str], limit: int = 20) -> DataFrame:
        return stats.together_with(self.lib, names, limit)

    def related_tag(self, name: str, category: str | None = None, limit: int = 25) -> DataFrame:
        return stats.related(self.lib, name, category, limit)

    def artists(self) -> DataFrame:
        a = self.lib.tag_aliases.groupBy(F.col("target_tag_id").alias("id")).agg(F.sort_array(F.collect_list("alias_name")).alias("aliases"))
        return self.lib.tags.filter("category = 'artist'").join(a, "id", "left").select("id", "name", "aliases")

    def pools(self, media_id: int | None = None) -> DataFrame:
        """Albums as pools with their flattened media; those of one medium if given."""
        pools = self.lib.albums if media_id is None else self.media_albums(media_id)
        flat = A.rows_below(self.lib).select(F.col("top").alias("id"), "media_id").distinct().join(pools.select("id"), "id", "left_semi")
        return pools.join(flat.groupBy("id").agg(F.sort_array(F.collect_list("media_id")).alias("media_ids")), "id", "left")
