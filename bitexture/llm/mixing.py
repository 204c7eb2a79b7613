"""Mixing sources to target weights with Pfair windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitexture.llm.order import NO_SOURCE, hashed_positions, seeded_key, source_key

#: Slots of one period; a target weight is a whole number of them.
SHARES = 1_024
#: Target weights default to (rows of the source) ** TEMPERATURE.
TEMPERATURE = 0.9
BLOCK_ROWS = 16


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def target_shares(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    shares: int = SHARES,
    temperature: float = TEMPERATURE,
    source: str = "source",
) -> DataFrame:
    """One row that holds all sources: ``names``, ``sizes`` (rows), ``parts``
    (whole shares that sum up to ``total``).

    A share is the weight times ``shares``, rounded, and at least one. Sources
    that ``weights`` doesn't name get no share and no slot. One row holds as
    many entries as there are sources, which is the size of a weight table.
    """
    sizes = docs.groupBy(source_key(source).alias("__src")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        sizes = sizes.withColumn("__w", F.pow(F.col("__n").cast("double"), F.lit(temperature)))
    else:
        given = [x for k, v in weights.items() for x in (F.lit(NO_SOURCE if k is None else k), F.lit(float(v)))]
        sizes = sizes.withColumn("__w", F.create_map(*given)[F.col("__src")]).where("__w > 0")
    rows = F.array_sort(F.collect_list(F.struct("__src", "__n", "__w")))
    one = sizes.agg(rows.alias("__s"))
    total = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x["__w"])
    part = F.transform(
        "__s", lambda x: F.greatest(F.lit(1), F.round(x["__w"] * shares / F.col("__sum"))).cast("bigint")
    )
    return (
        one.withColumn("__sum", total)
        .select(
            F.col("__s.__src").alias("names"), F.col("__s.__n").alias("sizes"), part.alias("parts")
        )
        .withColumn("total", F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x))
    )


def period(shares: DataFrame) -> DataFrame:
    """``__src, part, total, block, slot, release, deadline``: the slots of
    one period.

    Block ``i`` of a source with weight ``w = part / total`` may start at slot
    ``floor(i / w)`` and must end by ``ceil((i + 1) / w)``. Each slot takes,
    of the blocks that may start, the one with the earliest deadline (ties: the
    first source by name). Unit jobs with such windows always meet their
    deadlines, so a source is never a whole block off its weight; all windows
    close at the period's end, and the next period repeats the same slots.
    """
    src = F.sequence(F.lit(0), F.size("parts") - 1)
    done = F.transform("parts", lambda x: F.lit(0).cast("bigint"))

    def choose(state: Column, t: Column) -> Column:
        def window(i: Column) -> Column:
            c, p = state["done"][i], F.col("parts")[i]
            deadline = _div((c + 1) * F.col("total") + p - 1, p)
            open_now = (c < p) & (_div(c * F.col("total"), p) <= t)
            return F.struct(F.when(open_now, deadline).otherwise(F.lit(2**62)).alias("d"), i.alias("i"))

        return F.array_min(F.transform(src, window))["i"]

    def step(state: Column, t: Column) -> Column:
        pick = choose(state, t)
        # the pick is computed once, as the only element of an array
        return F.transform(
            F.array(pick),
            lambda p: F.struct(
                F.transform(state["done"], lambda c, i: F.when(i == p, c + 1).otherwise(c)).alias("done"),
                F.concat(state["picks"], F.array(F.struct(p.alias("i"), state["done"][p].alias("block")))).alias("picks"),
            ),
        )[0]

    start = F.struct(done.alias("done"), F.array().cast("array<struct<i:int,block:bigint>>").alias("picks"))
    slots = F.when(F.col("total") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1))
    picks = F.aggregate(slots, start, step, lambda s: s["picks"])
    at = shares.select("*", F.posexplode(picks).alias("slot", "__p"))
    part = F.col("parts")[F.col("__p.i")]
    return at.select(
        F.col("names")[F.col("__p.i")].alias("__src"),
        part.alias("part"),
        "total",
        F.col("__p.block").alias("block"),
        F.col("slot").cast("bigint").alias("slot"),
        _div(F.col("__p.block") * F.col("total"), part).alias("release"),
        _div((F.col("__p.block") + 1) * F.col("total") + part - 1, part).alias("deadline"),
    )


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: str = "mixture",
    shares: int = SHARES,
    temperature: float = TEMPERATURE,
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """Every row, once per epoch of its source, with its place in the mixture.

    Rows of a source are shuffled by seed and cut into blocks of
    ``block_rows``. Blocks take the slots of the Pfair schedule. The mixture
    ends where the source with most blocks for its weight has given all of
    them; a source that has fewer starts again (``mix_epoch``). So no row is
    lost, and in every prefix each source is less than one block off its
    target weight. ``mix_slot`` is the block's slot, ``mix_row`` the row's place
    in its block; (``mix_slot``, ``mix_row``) is the order of the mixture.

    Adds ``mix_slot, mix_row, mix_epoch, mix_block, mix_release,
    mix_deadline``, which replace input columns of these names. A NULL source
    is a source of its own, repeated and NULL keys are ordinary rows, an empty
    table gives an empty one. Sources without a weight are left out.
    """
    mine = ["mix_slot", "mix_row", "mix_epoch", "mix_block", "mix_release", "mix_deadline"]
    base = docs.drop(*mine).withColumn("__src", source_key(source)).withColumn("__h", seeded_key(seed, key))
    shared = target_shares(docs, weights, shares, temperature, source)
    # helper columns have names that no input has
    slots = period(shared).select(
        "__src", F.col("block").alias("__k"), *[F.col(c).alias(f"__{c}") for c in ("total", "slot", "release", "deadline")]
    )
    # per source: its share, its blocks, and the first slot after the mixture;
    # as many rows as sources
    sizes = shared.where("total > 0").select("total", F.explode(F.arrays_zip("names", "parts", "sizes")).alias("x"))
    table = sizes.select(
        F.col("total").alias("__total"),
        F.col("x.names").alias("__src"),
        F.col("x.parts").alias("__part"),
        _div(F.col("x.sizes") + block_rows - 1, F.lit(block_rows).cast("bigint")).alias("__blocks"),
    ).withColumn("__k", (F.col("__blocks") - 1) % F.col("__part"))
    last = _div(F.col("__blocks") - 1, F.col("__part")) * F.col("__total") + F.col("__slot")
    table = table.join(slots.select("__src", "__k", "__slot"), ["__src", "__k"]).withColumn(
        "__end", F.max(last).over(Window.partitionBy(F.lit(1))) + 1
    )
    table = table.select("__src", "__part", "__blocks", "__end", "__total")
    ranked = hashed_positions(base, "__src", "__h", [F.col(key)], "__rank", "__of")
    own = _div(F.col("__rank"), F.lit(block_rows).cast("bigint"))
    # blocks that fit into the mixture, and as many epochs as they ask for
    room = (_div(F.col("__end") - 1, F.col("__total")) + 1) * F.col("__part")
    epochs = F.sequence(F.lit(0).cast("bigint"), _div(room - 1 - F.col("__own"), F.col("__blocks")))
    repeated = (
        ranked.withColumn("__own", own)
        .join(table, "__src")
        .withColumn("mix_epoch", F.explode(epochs))
        .withColumn("mix_block", F.col("mix_epoch") * F.col("__blocks") + F.col("__own"))
        .withColumn("__k", F.col("mix_block") % F.col("__part"))
        .drop("__total")
    )
    turn = _div(F.col("mix_block"), F.col("__part")) * F.col("__total")
    return (
        repeated.join(slots, ["__src", "__k"])
        .withColumn("mix_slot", turn + F.col("__slot"))
        .where(F.col("mix_slot") < F.col("__end"))
        .withColumn("mix_row", (F.col("__rank") % block_rows).cast("int"))
        .withColumn("mix_release", turn + F.col("__release"))
        .withColumn("mix_deadline", turn + F.col("__deadline"))
        .select(*[c for c in docs.columns if c not in mine], *mine)
    )
