"""Items that appear together: an incremental, signed pair table over baskets.

State, as tables in the shared folder, each cut into buckets that are written and replaced one by one: memberships by basket, pair counts (a < b, n) in a grid of
cells (bucket of a, bucket of b), marginals by item, scores in the cells of their pairs. A batch of changed rows is compared with the memberships of the
baskets it touches; those baskets emit signed deltas only for pairs that hold an added or removed item, the deltas are merged into
the cells they fall into, and a cell's scores are computed again only if a count or a marginal in it changed since. What a batch doesn't touch is neither read nor written.

Defined results: rows with a null basket or item are no membership; a repeated (basket, item) counts once; an empty
batch leaves the state as it is; extra columns are ignored. A basket larger than ``block`` items is cut into blocks by a hash of the item before any
array is made, and its block pairs are spread over the cluster, so no row or task holds a whole large basket or all its pairs.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.session import Scratch, drop_table, salted_join, small_enough, subfolders

#: Items of a basket that one row of the pair generator holds, about.
BLOCK = 64
#: Side of the grid of pair cells, and buckets of memberships and marginals; to be raised with the data, about one cell for each 256 MB.
GRID = 4
#: Rows of a basket or item beyond which a join splits it.
HOT_ROWS = 500_000


class Buckets:
    """A table in buckets, each a folder; a bucket is replaced without touching the others."""

    def __init__(self, scratch: Scratch, key: str, columns: str):
        self.scratch, self.key, self.columns = scratch, key, columns
        self.paths: dict[str, str] = {}
        self.written = 0  # bytes of the last replacement

    def read(self, chosen: set[str] | None = None) -> DataFrame:
        paths = [p for k, p in self.paths.items() if chosen is None or k in chosen]
        spark = self.scratch.spark
        return spark.read.schema(self.columns).parquet(*paths) if paths else spark.createDataFrame([], self.columns)

    def replace(self, df: DataFrame, chosen: set[str] | None) -> None:
        """Puts the rows of ``df``, which has the key column, in place of the chosen buckets (None: of all)."""
        path = self.scratch.write(df, [self.key])
        found = subfolders(self.scratch.spark, path)
        self.written = sum(found.values())
        old = [p for k, p in self.paths.items() if chosen is None or k in chosen]
        self.paths = {k: p for k, p in self.paths.items() if p not in set(old)} | {name.split("=", 1)[1]: f"{path}/{name}" for name in found}
        drop_table(self.scratch.spark, *old)


def _bucket(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def sizes_of(members: DataFrame) -> DataFrame:
    """(basket, n_rows, changed, had, has): memberships looked at, whether any changed, and whether the basket was and is there."""
    some = lambda cond: F.max(F.when(F.expr(cond), 1).otherwise(0))
    return members.groupBy("basket").agg(F.count("*").alias("n_rows"), some("s <> 0").alias("changed"), some("s <= 0").alias("had"), some("s >= 0").alias("has"))


def signed_pairs(members: DataFrame, sizes: DataFrame, block: int = BLOCK, hot_rows: int = HOT_ROWS, all_new: bool = False) -> DataFrame:
    """(a, b, n) net pair deltas of rows (basket, item, s), each (basket, item) once: s is 1 for an added, -1 for a removed and 0 for a kept item; ``all_new`` says that s is 1 everywhere.

    A pair of items counts the sign of the sum of their s: an added item makes pairs with added and kept ones, a removed item breaks those with
    removed and kept ones, and what comes never met what goes. Baskets without a change and pairs of kept items are not visited.
    """
    large = sizes.filter((F.col("n_rows") > block) | (F.col("changed") == 0)).select("basket", F.ceil(F.col("n_rows") / block).cast("int").alias("nb"), "n_rows", "changed")
    if small_enough(large):
        rows = members.join(F.broadcast(large.drop("n_rows")), "basket", "left")
    else:
        rows = salted_join(members, large, "basket", "item", "left", hot_rows)
    rows = rows.filter(F.coalesce("changed", F.lit(1)) > 0).select("basket", "item", "s", F.coalesce("nb", F.lit(1)).alias("nb"))
    rows = rows.withColumn("k", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("item"), F.col("nb"))).otherwise(0).cast("int"))
    if all_new:
        listed, head = F.collect_list("item"), F.count("*").cast("int")
        item, sign = lambda c: F.col(c), lambda: F.lit(1)
    else:
        listed = F.sort_array(F.collect_list(F.struct((-F.abs("s")).cast("tinyint").alias("o"), "item", "s")))  # the changed ones first
        head = F.sum(F.abs("s")).cast("int")
        item, sign = lambda c: F.col(f"{c}.item"), lambda: F.signum(F.col("x.s") + F.col("y.s")).cast("int")
    blocks = rows.groupBy("basket", "nb", "k").agg(listed.alias("items"), head.alias("head"))
    own = blocks.filter("head > 0").select(F.col("items").alias("xs"), F.col("items").alias("ys"), "head", F.lit(True).alias("same"))
    # Of a basket of several blocks each goes to all cells of its row and column; the two blocks of a cell meet there.
    many = blocks.filter("nb > 1")
    cells = many.select("basket", "k", "items", "head", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")).filter("other <> k")
    cells = cells.select("basket", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), (F.col("k") < F.col("other")).alias("left"), "items", "head")
    of = lambda side, col: F.max(F.when(F.col("left") == side, F.col(col)))
    meets = cells.groupBy("basket", "i", "j").agg(*[F.first(F.when(F.col("left") == side, F.col("items")), ignorenulls=True).alias(f"items_{side}") for side in (True, False)], of(True, "head").alias("head_l"), of(False, "head").alias("head_r"))
    meets = meets.filter("items_true is not null and items_false is not null")
    one = meets.select(F.col("items_true").alias("xs"), F.col("items_false").alias("ys"), F.col("head_l").alias("head"), F.lit(False).alias("same"))
    two = meets.select(F.slice("items_false", 1, F.col("head_r")).alias("xs"), F.slice("items_true", F.col("head_l") + 1, F.size("items_true")).alias("ys"), F.col("head_r").alias("head"), F.lit(False).alias("same"))
    pairs = own.unionByName(one).unionByName(two).filter("head > 0 and size(ys) > 0")
    pairs = pairs.select("ys", "same", F.posexplode(F.slice("xs", 1, F.col("head"))).alias("p", "x"))
    pairs = pairs.select("x", F.explode(F.when(F.col("same"), F.slice("ys", F.col("p") + 2, F.size("ys"))).otherwise(F.col("ys"))).alias("y"))
    out = pairs.select(F.least(item("x"), item("y")).alias("a"), F.greatest(item("x"), item("y")).alias("b"), sign().alias("sign"))
    out = out if all_new else out.filter("sign <> 0")
    return out.groupBy("a", "b").agg(F.sum("sign").alias("n")).filter("n <> 0")


class PairTable:
    """Persistent pair counts that absorb batches of basket changes; scores are kept of pairs with at least ``min_count`` joint baskets."""

    def __init__(self, spark: SparkSession, label: str = "pairs", grid: int = GRID, block: int = BLOCK, min_count: int = 1):
        self.spark, self.scratch = spark, Scratch(spark, label)
        self.grid, self.block, self.min_count = grid, block, min_count
        self.members = self.counts = self.singles = self.scored = None
        self.n_baskets = 0
        self.dirty: set[str] = set()

    def _open(self, kinds: dict[str, str]) -> None:
        basket, item = kinds["basket"], kinds["item"]
        self.members = Buckets(self.scratch, "bucket", f"basket {basket}, item {item}")
        self.counts = Buckets(self.scratch, "cell", f"a {item}, b {item}, n bigint")
        self.singles = Buckets(self.scratch, "bucket", f"item {item}, n bigint")
        self.scored = Buckets(self.scratch, "cell", f"a {item}, b {item}, n bigint, n_a bigint, n_b bigint")

    def _cell(self, a: str, b: str) -> Column:
        return _bucket(a, self.grid) * self.grid + _bucket(b, self.grid)

    @staticmethod
    def _values(df: DataFrame, column: str) -> set[str]:
        return {str(r[0]) for r in df.select(column).distinct().collect()}  # at most grid * grid

    @property
    def pairs(self) -> DataFrame:
        return self.counts.read()

    @property
    def marginals(self) -> DataFrame:
        return self.singles.read()

    def apply(self, rows: DataFrame, basket: str, item: str, removed: DataFrame | None = None) -> PairTable:
        """Adds the memberships in ``rows`` and takes away those in ``removed`` (removal first, so a membership in both stays)."""
        named = lambda df, op: df.select(F.col(basket).alias("basket"), F.col(item).alias("item"), F.lit(op).alias("op")).dropna(subset=["basket", "item"])
        changes = named(rows, 1) if removed is None else named(rows, 1).unionByName(named(removed, -1))
        changes = changes.groupBy("basket", "item").agg(F.max("op").alias("op"))
        if self.members is None:
            self._open({f.name: f.dataType.simpleString() for f in changes.schema})
        if not self.members.paths:
            touched: set[str] = set()
            state = self.members.read(touched)
            changed = changes.filter("op = 1").select("basket", "item", F.lit(1).alias("s"))
        else:
            changes = self.scratch.put(changes)
            touched = self._values(changes.select(_bucket("basket", self.grid).alias("t")), "t")
            state = self.members.read(touched)
            asked = changes.select("basket").distinct()
            old = state.join(asked, "basket", "left_semi").withColumn("there", F.lit(True))
            sign = F.when(F.col("there").isNull(), F.when(F.col("op") == 1, 1)).otherwise(F.when(F.col("op") == -1, -1).otherwise(0))
            changed = changes.join(old, ["basket", "item"], "full").select("basket", "item", sign.alias("s")).filter("s is not null")
        changed = self.scratch.put(changed)
        if changed.isEmpty():
            return self
        sizes = self.scratch.put(sizes_of(changed))
        had, has = sizes.agg(F.sum("had"), F.sum("has")).first()
        self.n_baskets += has - had

        deltas, cells = None, set()
        made = signed_pairs(changed, sizes, self.block, all_new=not touched).withColumn("cell", self._cell("a", "b"))
        if not self.counts.paths:
            self.counts.replace(made, None)
        else:
            deltas = self.scratch.put(made)
            cells = self._values(deltas, "cell")
        if cells:
            merged = self.counts.read(cells).unionByName(deltas.drop("cell")).groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n <> 0")
            self.counts.replace(merged.withColumn("cell", self._cell("a", "b")), cells)

        moved = self.scratch.put(changed.groupBy("item").agg(F.sum("s").alias("n")).filter("n <> 0").withColumn("bucket", _bucket("item", self.grid)))
        if lines := self._values(moved, "bucket"):
            singles = self.singles.read(lines).unionByName(moved.drop("bucket")).groupBy("item").agg(F.sum("n").alias("n")).filter("n <> 0")
            self.singles.replace(singles.withColumn("bucket", _bucket("item", self.grid)).repartition("bucket"), lines)
        # a pair's score changes only if a marginal or, where as much came as went, its own count does
        self.dirty |= cells | {str(i * self.grid + j) for i, j in product(range(self.grid), repeat=2) if {str(i), str(j)} & lines}

        now = changed.filter("s >= 0").select("basket", "item")
        if touched:
            now = now.unionByName(state.join(changed.select("basket").distinct(), "basket", "left_anti"))
        self.members.replace(now.withColumn("bucket", _bucket("basket", self.grid)), touched)
        self.scratch.drop(changed, sizes, deltas, moved, changes)
        return self

    def _rescore(self) -> None:
        """Scores of the cells that changed since the last time."""
        cells, self.dirty = self.dirty, set()
        pairs = self.counts.read(cells).filter(F.col("n") >= self.min_count)
        lines = {str(x) for cell in cells for x in divmod(int(cell), self.grid)}
        side = self.singles.read(lines)
        if small_enough(side):
            join = lambda df, end: df.join(F.broadcast(side.select(F.col("item").alias(end), F.col("n").alias(f"n_{end}"))), end)
        else:  # an item's number of pairs is counted first, so that hot ones are split

            def join(df: DataFrame, end: str) -> DataFrame:
                rows = df.groupBy(end).agg(F.count("*").alias("n_rows"))
                return salted_join(df, rows.join(side.select(F.col("item").alias(end), F.col("n").alias(f"n_{end}")), end), end, "b" if end == "a" else "a", "inner", HOT_ROWS)

        scored = join(join(pairs, "a"), "b").select("a", "b", "n", "n_a", "n_b")
        self.scored.replace(scored.withColumn("cell", self._cell("a", "b")), cells)

    def scores(self, min_count: int | None = None) -> DataFrame:
        """(a, b, n, n_a, n_b, lift): lift is n * N / (n_a * n_b), how much more often than chance the pair occurs."""
        least = self.min_count if min_count is None else min_count
        if least < self.min_count:
            raise ValueError(f"pairs with fewer than {self.min_count} joint baskets have no score in this table")
        if self.members is None:
            raise ValueError("no batch was applied yet")
        if self.dirty:
            self._rescore()
        out = self.scored.read().filter(F.col("n") >= least)
        return out.withColumn("lift", F.col("n") * F.lit(float(self.n_baskets)) / (F.col("n_a").cast("double") * F.col("n_b")))


def together(table: PairTable, min_count: int, min_lift: int) -> DataFrame:
    """The pairs with at least ``min_count`` joint baskets and a lift of at least ``min_lift``, compared in whole numbers."""
    big = lambda c: F.col(c).cast("decimal(19,0)")
    scored = table.scores(min_count)
    return scored.filter(big("n") * F.lit(table.n_baskets).cast("decimal(18,0)") >= big("n_a") * big("n_b").cast("decimal(18,0)") * F.lit(min_lift).cast("decimal(1,0)"))
