"""Greedy reductions of many groups at once, as rounds over stored tables; and palettes by median cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.order import prefix_sums, row_numbers
from tessera.sources.shared import discard, stored

#: Scales of the ranking key, in which bits are shifted left and losses counted in steps.
KEY_BITS, LOSS_STEPS = 20, 24


def ranking_key(bits: Column, loss: Column) -> Column:
    """Bits saved per unit of loss in whole numbers; 0 for bits of 0 or below. A loss that rounds to nothing counts as one step."""
    steps = F.greatest(F.least(F.greatest(loss.cast("double"), F.lit(0.0)) * (1 << LOSS_STEPS), F.lit(9e18)).cast("long"), F.lit(1))
    whole = F.least(bits.cast("long"), F.lit(1 << 42)) * (1 << KEY_BITS)
    return F.when(bits > 0, F.call_function("div", whole, steps)).otherwise(F.lit(0)).cast("long")


def terminal_reduction(edits: DataFrame, groups: DataFrame, by: Sequence[str], chain: Sequence[str], place: str, bits: str, loss: str, room: str, initial: int = 8, least: int = 1, most: int = 512, share: float = 0.0, floor: float = 0.0, max_rounds: int = 16, max_tries: int = 32) -> DataFrame:
    """by, applied, bits_saved, lost, rounds, tries, rolled_back: a batched greedy in each group, all groups advancing together.

    edits are removals along chains (by, chain) in order of place: only a chain's first one left is open, and applying it opens
    the next. groups has by and room: the loss that the group may take altogether. A round ranks its open edits by `ranking_key`, the
    best first, ties by the chain, leaves out those without bits saved or below floor times the best key, and tries the
    first of them, as many as its batch. If their losses fit the room they are applied and the batch doubles, to at most most; else it
    halves, to no less than least, and is tried again; at least it ends the group. share sizes the first batch by the edits
    of the first round. A group ends without open edits, after max_rounds applied batches or max_tries tries.

    Each try is a step for all groups that have not ended, so the steps are at most max_tries; open edits are ranked only when a batch was
    applied, in two levels, so a group of any size is spread over tasks. State and ranks are tables of the shared folder, and
    replaced ones are removed. Null bits or losses count as 0; groups without edits are returned with zeros; edits of unknown
    groups are left out. Keys may be null. (chain, place) must be unique in a group.
    """
    keys, links = list(by), list(chain)
    clean = edits.select(*keys, *links, F.col(place).alias("_at"), F.coalesce(F.col(bits), F.lit(0)).cast("long").alias("_bits"), F.coalesce(F.col(loss), F.lit(0.0)).cast("double").alias("_loss"))
    steps = Window.partitionBy(*keys, *links).orderBy("_at")
    edits = stored(clean.withColumn("_key", ranking_key(F.col("_bits"), F.col("_loss"))).withColumn("_k", F.row_number().over(steps)), "edits")
    zero = {"_batch": max(initial, 1), "applied": 0, "bits_saved": 0, "rounds": 0, "tries": 0, "rolled_back": 0}
    state = groups.select(*keys, F.col(room).cast("double").alias("_room")).withColumns({c: F.lit(v).cast("long") for c, v in zero.items()})
    state = stored(state.withColumns({"lost": F.lit(0.0), "_new": F.lit(True), "_done": F.lit(max_rounds < 1 or max_tries < 1)}), "groups")
    opened, ranked = None, None
    for _ in range(max_tries):
        fresh = state.where(F.col("_new") & ~F.col("_done"))
        if ranked is None or not fresh.isEmpty():
            # Chains that a batch has moved open their next edit; the others keep theirs.
            now = edits.where("_k = 1") if opened is None else _opened(edits, opened, ranked, state, keys, links)
            now = _same(now, state.where(~F.col("_done")).select(*keys), keys)
            best = now.groupBy(*keys).agg(F.max("_key").alias("_best"))
            kept = _same(now, best, keys).where((F.col("_bits") > 0) & (F.col("_key") >= F.floor(F.col("_best").cast("double") * floor)))
            new = row_numbers(kept.drop("_best"), keys, [F.desc("_key"), *[F.col(c) for c in links]], "_r")
            old, opened = (opened, ranked), stored(now, "open")
            ranked = stored(prefix_sums(new, keys, [F.col("_r")], {"_before": F.col("_loss"), "_bits_before": F.col("_bits")}), "ranked")
            for table in old:
                if table is not None:
                    discard(table)
        sizes = ranked.groupBy(*keys).agg(F.max("_r_all").alias("_n"))
        live = _same(state, sizes, keys, "left")
        sized = F.when((F.col("rounds") == 0) & (F.col("tries") == 0) & F.lit(share > 0), F.greatest(F.least(F.greatest(F.floor(F.col("_n") * share), F.lit(initial)), F.lit(most)), F.lit(1))).otherwise(F.col("_batch"))
        live = live.withColumn("_batch", F.when(F.col("_done"), F.col("_batch")).otherwise(sized).cast("long")).withColumn("_done", F.col("_done") | F.col("_n").isNull())
        live = stored(live.withColumn("_take", F.least("_batch", "_n")), "tried")
        # The batch ends at one row, whose sums say what it costs.
        last = _same(ranked.select(*keys, "_r", (F.col("_before") + F.col("_loss")).alias("_cost"), (F.col("_bits_before") + F.col("_bits")).alias("_gain")), live.where(~F.col("_done")).select(*keys, "_take"), keys).where(F.col("_r") == F.col("_take")).drop("_r", "_take")
        tried = _same(live, last, keys, "left")
        fits = F.col("lost") + F.col("_cost") <= F.col("_room")
        on, hit = ~F.col("_done"), ~F.col("_done") & fits
        state_ = tried.select(
            *keys, "_room",
            F.when(hit, F.least(F.col("_batch") * 2, F.lit(max(most, 1)))).when(on, F.greatest(F.floor(F.col("_batch") / 2), F.lit(max(least, 1)))).otherwise(F.col("_batch")).cast("long").alias("_batch"),
            (F.col("applied") + F.when(hit, F.col("_take")).otherwise(0)).alias("applied"), (F.col("bits_saved") + F.when(hit, F.col("_gain")).otherwise(0)).alias("bits_saved"),
            (F.col("rounds") + F.when(hit, 1).otherwise(0)).alias("rounds"), (F.col("tries") + F.when(on, 1).otherwise(0)).alias("tries"), (F.col("rolled_back") + F.when(on & ~fits, F.col("_take")).otherwise(0)).alias("rolled_back"),
            (F.col("lost") + F.when(hit, F.col("_cost")).otherwise(0.0)).alias("lost"), F.coalesce(hit, F.lit(False)).alias("_new"), F.when(hit, F.col("_take")).alias("_moved"),
            (F.col("_done") | (~fits & (F.col("_batch") <= max(least, 1))) | (F.col("rounds") + F.when(hit, 1).otherwise(0) >= max_rounds) | (F.col("tries") + 1 >= max_tries)).alias("_done"),
        )
        before, state = state, stored(state_, "groups")
        for table in (before, live):
            discard(table)
        if state.where(~F.col("_done")).isEmpty():
            break
    return state.select(*keys, "applied", "bits_saved", "lost", "rounds", "tries", "rolled_back")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, nulls of the keys equal."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_k_{k}"])
    return left.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def _opened(edits: DataFrame, opened: DataFrame, ranked: DataFrame, state: DataFrame, keys: Sequence[str], links: Sequence[str]) -> DataFrame:
    """Open edits after each group's last batch: those applied give way to their chain's next."""
    moved = _same(ranked.select(*keys, *links, "_k", "_r"), state.where("_moved is not null").select(*keys, "_moved"), keys).where("_r <= _moved").select(*keys, *links, (F.col("_k") + 1).alias("_next"))
    at = _same(opened.select(*keys, *links, "_k"), moved, [*keys, *links], "left").select(*keys, *links, F.coalesce("_next", "_k").alias("_open"))
    return _same(edits, at, [*keys, *links]).where("_k = _open").drop("_open")


# ---- palettes

AXES = ("r", "g", "b")


def median_cut(colours: DataFrame, by: Sequence[str], weight: str, k: int) -> DataFrame:
    """by, r, g, b, weight, box, and the box's palette entry p_r, p_g, p_b: at most k boxes for each group's weighted colours.

    The box with the widest span, summed over the axes, is split first (ties: the oldest number), at the weighted median of
    its longest axis (ties: r, g, b), with at least one colour on each side; the upper part is a new box with the next number.
    A box's entry is the weighted mean of its colours, halves rounded up. Groups of at most k colours keep theirs. Colours must be distinct in
    their group; null colours or weights are left out; weights are whole numbers of at least 1; k counts as 2 at least.

    A part never is wider than what it was cut from, so all boxes that the split order reaches next can be cut at once: a round
    cuts every box that is among the k - 1 widest still uncut, of all groups, with medians from prefix sums in two levels; at
    the end the splits are put in order, and those after the k-th box are taken back. Rounds are at most k - 1; a round's boxes
    are at most k for each group.
    """
    keys, k = list(by), max(k, 2)
    rows = colours.select(*keys, *AXES, F.col(weight).cast("long").alias("weight")).dropna(subset=[*AXES, "weight"])
    every = stored(rows, "colours")
    sizes = every.groupBy(*keys).agg(F.count("*").alias("_colours"))
    few = _same(every, sizes.where(F.col("_colours") <= k), keys).drop("_colours")
    few = few.withColumn("box", F.row_number().over(Window.partitionBy(*keys).orderBy(*AXES)) - 1).select(*keys, *AXES, "weight", "box", *[F.col(a).cast("int").alias(f"p_{a}") for a in AXES])
    rows = _same(every, sizes.where(F.col("_colours") > k), keys).drop("_colours")
    # _node is a path in the tree of cuts: 1 is the group's box, 2 n and 2 n + 1 its lower and upper part, as text since paths may be long.
    rows = stored(rows.withColumn("_node", F.lit("1")), "boxes")
    nodes = stored(_boxes(rows, keys), "nodes")
    while True:
        wanted = stored(_wanted(nodes, keys, k), "wanted")
        if wanted.isEmpty():
            break
        chosen = _same(rows, wanted.select(*keys, "_node", "_axis", "_weight"), [*keys, "_node"])
        order = F.when(F.col("_axis") == 0, F.col("r")).when(F.col("_axis") == 1, F.col("g")).otherwise(F.col("b"))
        summed = prefix_sums(chosen.withColumn("_v", order), [*keys, "_node"], [F.col("_v"), F.col("r"), F.col("g"), F.col("b")], {"_before": F.col("weight"), "_place": F.lit(1)})
        # The lower part ends with the first colour that reaches half the weight, but leaves one.
        reaches = F.col("_before") + F.col("weight") >= F.floor(F.col("_weight") / 2)
        cut = summed.groupBy(*keys, "_node").agg(F.min(F.when(reaches, F.col("_place"))).alias("_cut"))
        cut = _same(summed, cut, [*keys, "_node"])
        side = F.when(F.col("_place") <= F.least(F.coalesce("_cut", F.lit(0)), F.col("_place_all") - 2), "0").otherwise("1")
        parts = cut.select(*keys, *AXES, "weight", F.concat("_node", side).alias("_node"))
        rest = _anti(rows, wanted, [*keys, "_node"])
        old_rows, rows = rows, stored(rest.unionByName(parts), "boxes")
        fresh = _same(rows, wanted.select(*keys, F.explode(F.array(F.concat("_node", F.lit("0")), F.concat("_node", F.lit("1")))).alias("_node")), [*keys, "_node"])
        old_nodes, nodes = nodes, stored(_anti(nodes, wanted, [*keys, "_node"]).unionByName(_same(nodes, wanted.select(*keys, "_node"), [*keys, "_node"]).withColumn("_cut", F.lit(True))).unionByName(_boxes(fresh, keys)), "nodes")
        for table in (old_rows, old_nodes, wanted):
            discard(table)
    numbered = _numbered(nodes, keys, k)
    leaf = numbered.where("_leaf").select(*keys, F.col("_node").alias("_of"), "box")
    # A colour's box is the longest leaf that its path begins with: the path itself, unless its cut was taken back.
    found = _prefixed(rows, leaf, keys)
    w = F.col("weight")
    mean = lambda a: F.floor((F.sum(F.col(a) * w) + F.floor(F.sum(w) / 2)) / F.greatest(F.sum(w), F.lit(1))).cast("int").alias(f"p_{a}")
    entries = found.groupBy(*keys, "box").agg(*[mean(a) for a in AXES])
    return _same(found, entries, [*keys, "box"]).select(*keys, *AXES, "weight", "box", *[f"p_{a}" for a in AXES]).unionByName(few)


def _anti(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(named[f"_k_{k}"])
    return left.join(named, on, "left_anti")


def _boxes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """by, _node, _n, _weight, _span, _axis, _cut of each box."""
    spans = [F.max(a) - F.min(a) for a in AXES]
    at = F.when((spans[0] >= spans[1]) & (spans[0] >= spans[2]), 0).when(spans[1] >= spans[2], 1).otherwise(2)
    return rows.groupBy(*keys, "_node").agg(F.count("*").alias("_n"), F.sum("weight").alias("_weight"), sum(spans, F.lit(0)).alias("_span"), at.alias("_axis"), F.lit(False).alias("_cut"))


def _wanted(nodes: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Uncut boxes of more than one colour that are among their group's k - 1 widest, cut ones included (ties all)."""
    widest = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("_span")))
    return nodes.where("_n > 1").withColumn("_rank", widest).where((F.col("_rank") <= k - 1) & ~F.col("_cut")).drop("_rank")


def _numbered(nodes: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """by, _node, box, _leaf: the boxes after k - 1 splits in order, numbered as they come to be.

    A group's boxes, of which there are a few times k, are put in order by one task.
    """
    import heapq

    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        known = {n: (int(s), bool(c)) for n, s, c in zip(pdf["_node"], pdf["_span"], pdf["_cut"], strict=True)}
        number, heap = {"1": 0}, []
        if known["1"][1]:
            heapq.heappush(heap, (-known["1"][0], 0, "1"))
        while heap and len(number) < k:
            _, box, node = heapq.heappop(heap)
            new = len(number)
            del number[node]
            number[node + "0"], number[node + "1"] = box, new
            for part in (node + "0", node + "1"):
                if known[part][1]:
                    heapq.heappush(heap, (-known[part][0], number[part], part))
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in keys], n, b, True] for n, b in number.items()], columns=[*keys, "_node", "box", "_leaf"])

    kinds = dict(nodes.dtypes)
    return nodes.groupBy(*keys).applyInPandas(one, ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], "_node string, box int, _leaf boolean"]))


def _prefixed(rows: DataFrame, leaf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the box of the leaf whose path theirs begins with: each of a path's beginnings is looked up."""
    paths = rows.select("_node", *keys).distinct()
    heads = paths.select(*keys, "_node", F.explode(F.transform(F.sequence(F.lit(1), F.length("_node")), lambda n: F.substring(F.col("_node"), F.lit(1), n))).alias("_of"))
    named = _same(heads, leaf, [*keys, "_of"]).select(*keys, "_node", "box")
    return _same(rows, named, [*keys, "_node"]).drop("_node")


def remapped(pixels: DataFrame, cut: DataFrame, by: Sequence[str]) -> DataFrame:
    """pixels with p_r, p_g, p_b: the palette entry nearest to each colour (ties: the box with the smallest number).

    The entries of a group are one array, at most k long; each distinct colour is compared with them once.
    """
    keys = list(by)
    entries = cut.groupBy(*keys, "box").agg(*[F.first(f"p_{a}").alias(f"p_{a}") for a in AXES])
    palette = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("box", *[f"p_{a}" for a in AXES]))).alias("_p"))
    square = lambda p, a: (F.col(a) - p[f"p_{a}"]) * (F.col(a) - p[f"p_{a}"])
    near = F.array_min(F.transform("_p", lambda p: F.struct((square(p, "r") + square(p, "g") + square(p, "b")).alias("d"), p["box"].alias("box"), *[p[f"p_{a}"].alias(f"p_{a}") for a in AXES])))
    mapped = _same(cut.select(*keys, *AXES), palette, keys).withColumn("_e", near).select(*keys, *AXES, *[F.col("_e")[f"p_{a}"].alias(f"p_{a}") for a in AXES])
    return _same(pixels, mapped, [*keys, *AXES], "left")
