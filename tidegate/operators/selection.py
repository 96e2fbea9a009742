"""A choice of records of which no two are alike: the better one of any two near twins stays.

What a loop over records in order of merit would choose, settled in rounds. A
record is chosen once no better undecided one is its twin, and goes once a chosen
one is. Twins share a token and lie within that token's distance, so a round only
looks at the best few undecided records of a token and a cell of a grid. Records
that are alike in all that twins are told by, and are twins of themselves, need
no round: only the best of them can be chosen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.spatial import Grid
from tidegate.session import cut

#: From the token columns (arrays of strings) to the metres within which records that share one may be twins.
Tokens = dict[str, float]


def _by_token(rows: DataFrame, tokens: Tokens, cells: Callable[[Grid], Column]) -> DataFrame:
    """Each record once for each of its tokens, with a column of cells of that token's grid."""
    out = None
    for name, metres in tokens.items():
        named = F.transform(F.array_distinct(name), lambda t: F.concat(F.lit(f"{name}:"), t))  # noqa: B023  used at once
        part = rows.withColumn("_token", F.explode(named)).withColumn("_cell", cells(Grid(metres)))
        out = part if out is None else out.unionByName(part)
    return out


def _placed(rows: DataFrame, tokens: Tokens) -> DataFrame:
    """Each record in its own cell."""
    return _by_token(rows, tokens, lambda grid: grid.cell(F.col("lat"), F.col("lon")))


def _looking(rows: DataFrame, tokens: Tokens) -> DataFrame:
    """Each record in each cell in which a twin may lie."""
    return _by_token(rows, tokens, lambda grid: F.explode(grid.around(F.col("lat"), F.col("lon"))))


def _pairs(rows: DataFrame, others: DataFrame) -> DataFrame:
    """a (of rows, looking) beside b (of others, placed) where they share a token and a cell."""
    a = rows.select("_token", "_cell", F.struct(*(c for c in rows.columns if c[0] != "_")).alias("a"))
    b = others.select(F.col("_token").alias("_t"), F.col("_cell").alias("_c"), F.struct(*(c for c in others.columns if c[0] != "_")).alias("b"), *(c for c in ("_n", "_of") if c in others.columns))
    return a.join(b, (a["_token"] == b["_t"]) & (a["_cell"]["y"] == b["_c"]["y"]) & (a["_cell"]["x"] == b["_c"]["x"]))


def _best_of_alike(rows: DataFrame, twins: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows without those that a better one equals in all but id and merit, where such rows are twins.

    A worse one is never chosen: either the better one is, or what keeps that
    one out is a twin of the worse one too.
    """
    told = [c for c in rows.columns if c not in ("id", "merit")]
    own = F.struct(*rows.columns)
    apart = F.when(~F.coalesce(twins(own, own), F.lit(False)), F.col("id"))  # such a row is a group by itself
    best = F.max_by(F.struct("id", "merit"), F.struct("merit", -F.col("id"))).alias("_best")
    return rows.withColumn("_apart", apart).groupBy(*told, "_apart").agg(best).select(*(F.col(f"_best.{c}") if c in ("id", "merit") else F.col(c) for c in rows.columns))


def choose_apart(rows: DataFrame, tokens: Tokens, twins: Callable[[Column, Column], Column], standing: DataFrame | None = None, listed: int = 4, rounds: int = 1000) -> DataFrame:
    """(id, chosen) for every record.

    `rows` has id (a distinct number), merit, lat, lon and the token columns; whatever
    `twins` reads of two records may stand beside them. Better is a larger merit,
    then a smaller id; a null merit is the least. Records of `standing`, which
    has the same columns, are chosen beforehand and are not in the result. Twins
    that share no token, or lie further apart than its metres, are not seen.

    `twins` must not read id or merit. A round lists the `listed` best undecided records of each token and cell. A
    record is only chosen where its lists reach down to it, so a crowded cell
    takes more rounds but no row is left out and no task gets a whole cell.
    """
    cols = [c for c in rows.columns if c[0] != "_"]
    rows = rows.select(*cols).withColumn("merit", F.coalesce(F.col("merit").cast("double"), F.lit(float("-inf"))))
    better = lambda b, a: (b["merit"] > a["merit"]) | ((b["merit"] == a["merit"]) & (b["id"] < a["id"]))

    def without_twins(left: DataFrame, of: DataFrame) -> DataFrame:
        gone = _pairs(_looking(left, tokens), _placed(of, tokens)).where(twins(F.col("a"), F.col("b"))).select(F.col("a.id").alias("id")).distinct()
        return left.join(gone, "id", "left_anti")

    best_of_alike = _best_of_alike(rows, twins)
    if standing is not None:
        told = [c for c in cols if c not in ("id", "merit")]
        best_of_alike = without_twins(best_of_alike, standing.select(*cols).dropDuplicates(told))
    undecided = cut(best_of_alike, "undecided")
    chosen: list[DataFrame] = []
    for _ in range(rounds):
        if undecided.isEmpty():
            break
        order = Window.partitionBy("_token", "_cell").orderBy(F.desc("merit"), "id")
        best = _placed(undecided, tokens).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= listed)
        met = _pairs(_looking(undecided, tokens), best).where(better(F.col("b"), F.col("a")))
        # held back by a better twin, or by a list that ends above it
        held = met.where(twins(F.col("a"), F.col("b")) | (F.col("_n") == listed)).select(F.col("a.id").alias("id")).distinct()
        now = cut(undecided.join(held, "id", "left_anti"), "chosen")
        chosen.append(now)
        undecided = cut(without_twins(undecided.join(now.select("id"), "id", "left_anti"), now), "undecided")
    else:
        raise RuntimeError(f"records are undecided after {rounds} rounds")
    picked = rows.select("id").limit(0)
    for c in chosen:
        picked = picked.unionByName(c.select("id"))
    return rows.select("id").join(picked.withColumn("_in", F.lit(True)), "id", "left").select("id", F.coalesce("_in", F.lit(False)).alias("chosen"))


def shares_words(a: Column, b: Column) -> Column:
    """Whether all words of one of two arrays are in the other; not where one has none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
