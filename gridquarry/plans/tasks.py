"""Search tasks and the front end that runs them: search(array, 'library:function', configuration)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.operators import regions, relax, sequence
from gridquarry.operators.synopsis import Synopsis, open_blocks
from gridquarry.plans.model import Array, Axis, Config, Domain, Relaxable, Span

Task = Callable[..., DataFrame]
TASKS: dict[str, Task] = {}


def task(*names: str) -> Callable[[Task], Task]:
    def register(f: Task) -> Task:
        for n in names:
            TASKS[n] = f
        return f

    return register


def parse_spec(spec: str) -> tuple[str, str, str]:
    """library, function and configuration file of 'library:function:file'."""
    parts = spec.split(":")
    if len(parts) != 3 or not all(parts):
        raise ValueError(f"expected library:function:file, got {spec}")
    return parts[0], parts[1], parts[2]


def search(array: Array, spec: str, config: Config | None = None, synopses: Sequence[Synopsis] = ()) -> DataFrame:
    """Run a registered task; nothing is computed before an action. Synopses prune and never change the result."""
    if config is None:
        library, function, path = parse_spec(spec)
        config, spec = Config.load(path), f"{library}:{function}"
    if spec not in TASKS:
        raise ValueError(f"no task {spec}; there are {', '.join(sorted(TASKS))}")
    return TASKS[spec](array, config, synopses)


def rounded(c: Column) -> Column:
    """Aggregates are compared as whole numbers, halves away from zero."""
    return F.round(c).cast("long")


def origin_domain(config: Config, p: str, variable: str, lo: int, hi: int) -> Domain:
    """Where windows begin: the variable's range, or the slice of it that the configuration asks for. The search space still ends at ``hi``."""
    part = config.get(f"{p}.slice", {})
    if part.get("variable") == variable:
        lo, hi = part["lo"], part["hi"]
    return Domain(lo, hi, config.num(f"{p}.step_{variable}", 1))


def window_axes(config: Config, p: str) -> tuple[Axis, Axis]:
    ends = {d: config.num(f"{p}.u{d}") for d in "xy"}
    return tuple(  # type: ignore[return-value]
        Axis(d, origin_domain(config, p, d, config.num(f"{p}.l{d}"), ends[d]), Domain(config.num(f"{p}.len_l{d}"), config.num(f"{p}.len_u{d}"), config.num(f"{p}.step_l{d}", 1)), ends[d])
        for d in "xy"
    )


def area(config: Config, p: str) -> Column:
    return (F.col("lx") * F.col("ly")).between(config.num(f"{p}.size_l"), config.num(f"{p}.size_u"))


def ring(n: int) -> list[tuple[Span, Span]]:
    """The four strips around a window: left, top, right, bottom; top and bottom take the corners."""
    wide, tall = Span(-n, 0, 2 * n, 1), Span()
    before, after = Span(-n, 0, n, 0), Span(0, 1, n, 0)
    return [(before, tall), (wide, before), (after, tall), (wide, after)]


def finish(rows: DataFrame, config: Config, constraints: list[tuple[Relaxable, Column]], columns: list[str]) -> DataFrame:
    """The constraints as they stand, or relaxed to the best results, or contracted to the top ones."""
    if not config.flag("relax.on"):
        ok = F.lit(True)
        for c, v in constraints:
            ok &= c.holds(v)
        return rows.where(ok).select(*columns)
    k, kind = config.num("relax.card", 10), config.num("relax.contr_type", 0)
    if kind == 1 and any(c.contract for c, _ in constraints):
        return relax.top_ranked(rows, constraints, k).withColumn("rd", F.lit(0.0)).select(*columns, "rd", "rank")
    if kind == 2 and any(c.contract for c, _ in constraints):
        ok = F.lit(True)
        for c, v in constraints:
            ok &= c.holds(v)
        goals = [(c.name, c.contract == 1) for c, _ in constraints if c.contract]
        return relax.skyline(rows.where(ok), goals).withColumn("rd", F.lit(0.0)).select(*columns, "rd")
    return relax.top_relaxed(rows, constraints, k, config.num("relax.dist_w", 0.5), config.num("relax.lrd", 1.0)).select(*columns, "rd")


def _prune(cells: DataFrame, axes: Sequence[Axis], synopses: Sequence[Synopsis], low: float, high: float) -> tuple[DataFrame, DataFrame | None, int]:
    """Cells that some open block of windows can touch, the open blocks, and their span in origins."""
    if not synopses:
        return cells, None, 0
    coarse = max(synopses, key=lambda s: s.volume)
    span = max(max(coarse.sizes), max(a.length.last for a in axes))
    blocks = open_blocks(axes, coarse, low, high, span)
    cover = blocks
    for a in axes:  # tiles of ``span`` cells that the windows of an open block reach
        reach = -(-(span + a.length.last) // span)
        cover = cover.withColumn(f"_c_{a.dim}", F.explode(F.sequence(F.col(f"_o_{a.dim}"), F.col(f"_o_{a.dim}") + reach)))
    tiles = cover.select(*[f"_c_{a.dim}" for a in axes]).distinct()
    on = [F.floor((F.col(a.dim) - a.origin.lo) / F.lit(span)) == F.col(f"_c_{a.dim}") for a in axes]
    return cells.join(tiles, on, "left_semi"), blocks, span


@task("sw:SemWindowsAvg", "windows:mean")
def mean_windows(array: Array, config: Config, synopses: Sequence[Synopsis] = (), p: str = "sw") -> DataFrame:
    """Windows whose mean lies in a range, and which stand out from a ring around them by their maximum or minimum.

    Columns x, y, lx, ly, avg and, where asked for, max_diff, min_diff, rd, rank. A window whose region or any of whose
    four strips holds no value is rejected and never relaxed.
    """
    axes = window_axes(config, p)
    on = config.flag("relax.on")
    n = config.num(f"{p}.neighborhood.size", 0)
    diffs = {k: config.num(f"{p}.neighborhood.{k}", 0) for k in ("max_diff", "min_diff")}
    asked = [k for k, v in diffs.items() if n and v]
    low, high = config.num(f"{p}.avg_l"), config.num(f"{p}.avg_u")
    mean = Relaxable("avg", low, high, config.num(f"{p}.avg_relax_l", low) if on else low, config.num(f"{p}.avg_relax_u", high) if on else high, contract=config.num(f"{p}.avg_contr", 0))
    cells, blocks, span = _prune(array.cells, axes, synopses, mean.max_l, mean.max_h)
    measure = {"v": F.col(config.get(f"{p}.attribute", "val"))}
    parts = ["sum", "count", *(["max"] if "max_diff" in asked else []), *(["min"] if "min_diff" in asked else [])]
    keys = [c for a in axes for c in (a.dim, a.length_col)]
    keep = area(config, p)
    found = regions.region_parts(cells, axes, (Span(), Span()), measure, parts, keep=keep).where("v_count > 0")
    found = found.withColumn("avg", rounded(F.col("v_sum") / F.col("v_count")))
    if blocks is not None:
        found = found.join(blocks, [F.floor((F.col(a.dim) - a.origin.lo) / F.lit(span)) == F.col(f"_o_{a.dim}") for a in axes], "left_semi")
    if not on and not asked:
        found = found.where(mean.holds(F.col("avg")))
    constraints = [(mean, F.col("avg"))]
    if asked:
        around = None
        for k, spans in enumerate(ring(n)):
            strip = regions.region_parts(array.cells, axes, spans, measure, ["max"], keep=keep).select(*keys, F.col("v_max").alias("m"), F.lit(1 << k).alias("side"))
            around = strip if around is None else around.unionByName(strip)
        around = around.where("m is not null").groupBy(*keys).agg(F.max("m").alias("nmax"), F.sum("side").alias("sides")).where("sides = 15")
        found = found.join(around, keys)
        for name in asked:
            found = found.withColumn(name, rounded(F.col(f"v_{name[:3]}")) - rounded(F.col("nmax")))
            d = diffs[name]
            where = f"{p}.neighborhood"
            limit = config.num(f"{where}.{name[:3]}_relax_diff", d) if on else d
            constraints.append((Relaxable(name, d, None, limit, contract=config.num(f"{where}.{name}_contr", 0), strict=not on, rank_l=d, rank_h=config.num(f"{where}.{name}_high", d + 1000)), F.col(name)))
    return finish(found, config, constraints, [*keys_in_order(axes), "avg", *asked])


def keys_in_order(axes: Sequence[Axis]) -> list[str]:
    return [a.dim for a in axes] + [a.length_col for a in axes]


@task("mimic:MimicAvg", "series:mean")
def mean_subsequences(array: Array, config: Config, synopses: Sequence[Synopsis] = (), p: str = "mimic") -> DataFrame:
    """Stretches of a record whose mean lies in a range and whose maximum exceeds that of the ticks to the left or right.

    Columns id, time, len, avg and, where asked for, left_diff, right_diff, rd, rank. Neighbours must lie in the time range.
    """
    on, near = config.flag("relax.on"), f"{p}.neighborhood"
    lo, hi = config.num(f"{p}.l_time"), config.num(f"{p}.u_time")
    left, right = config.num(f"{near}.l_size", 0), config.num(f"{near}.r_size", 0)
    axis = Axis("tick", origin_domain(config, p, "time", lo, hi), Domain(config.num(f"{p}.len_l"), config.num(f"{p}.len_u"), config.num(f"{p}.step_len", 1)), hi - right, "len")
    cells = array.cells.where(F.col("record").between(config.num(f"{p}.l_id"), config.num(f"{p}.u_id")))
    measure = {"v": F.col(config.get(f"{p}.signal", array.meta.attrs[0]))}
    sides = [(s, n, span) for s, n, span in (("left", left, Span(-left, 0, left, 0)), ("right", right, Span(0, 1, right, 0))) if n]
    keep = (F.col("tick") - left >= lo) & (F.col("tick") + F.col("len") + right <= hi + 1)
    found = regions.region_parts(cells, [axis], [Span()], measure, ["sum", "count", *(["max"] if sides else [])], ["record"], keep).where("v_count > 0")
    low, high = config.num(f"{p}.avg_l"), config.num(f"{p}.avg_u")
    mean = Relaxable("avg", low, high, config.num(f"{p}.avg_relax_l", low) if on else low, config.num(f"{p}.avg_relax_u", high) if on else high, contract=config.num(f"{p}.avg_contr", 0))
    found = found.withColumn("avg", rounded(F.col("v_sum") / F.col("v_count")))
    constraints = [(mean, F.col("avg"))]
    for side, _, span in sides:
        strip = regions.region_parts(cells, [axis], [span], measure, ["max"], ["record"], keep).where("v_max is not null").select("record", "tick", "len", F.col("v_max").alias(f"{side}_max"))
        found = found.join(strip, ["record", "tick", "len"]).withColumn(f"{side}_diff", rounded(F.col("v_max")) - rounded(F.col(f"{side}_max")))
        d = config.num(f"{near}.{side}_max_diff", 0)
        limit = config.num(f"{near}.{side}_relax_diff", d) if on else d
        constraints.append((Relaxable(f"{side}_diff", d, None, limit, contract=config.num(f"{near}.{side}_contr", 0), strict=not on, rank_l=d, rank_h=config.num(f"{near}.{side}_diff_high", d + 1000)), F.col(f"{side}_diff")))
    named = found.withColumnRenamed("record", "id").withColumnRenamed("tick", "time")
    return finish(named, config, constraints, ["id", "time", "len", "avg", *[f"{s}_diff" for s, _, _ in sides]])


@task("dist:Dist", "series:distance")
def near_subsequences(array: Array, config: Config, synopses: Sequence[Synopsis] = (), query: Sequence[float] | None = None, p: str = "dist") -> DataFrame:
    """Subsequences within a distance of a query sequence. Columns id, time, sqdist and, relaxed, rd; the relaxation is added to the square."""
    if query is None:
        given = config.need(f"{p}.query")
        from gridquarry.sources.files import read_sequence

        query = given if isinstance(given, list) else read_sequence(given)
    on = config.flag("relax.on")
    lo, hi = config.num(f"{p}.l_time"), config.num(f"{p}.u_time")
    cells = array.cells.where(F.col("record").between(config.num(f"{p}.l_id"), config.num(f"{p}.u_id")))
    signal = F.col(config.get(f"{p}.signal", array.meta.attrs[0]))
    found = sequence.squared_distances(cells, "record", "tick", signal, query, origin_domain(config, p, "time", lo, hi), hi)
    bound = config.num(f"{p}.dist", 0) ** 2
    # Distances are rounded up before they are compared.
    found = found.select(F.col("record").alias("id"), F.col("start").alias("time"), F.ceil("sqdist").cast("long").alias("sqdist"))
    limit = Relaxable("sqdist", None, bound, None, bound + config.num(f"{p}.dist_relax", 1) if on else bound)
    return finish(found, config, [(limit, F.col("sqdist"))], ["id", "time", "sqdist"])


@task("sdss:SdssUgrizAvg", "windows:bands")
def band_windows(array: Array, config: Config, synopses: Sequence[Synopsis] = (), p: str = "sdss") -> DataFrame:
    """Windows whose five bands each have a mean in avg_l..avg_h, a minimum of at least min_l and a maximum of at most min_h.

    A band counts if either of its two ranges is not inverted; then all its limits hold. Limits are cut to whole numbers.
    Columns x, y, lx, ly.
    """
    axes = window_axes(config, p)
    limit = lambda *keys: [int(v) for v in next(config.get(f"{p}.{k}") for k in keys if config.get(f"{p}.{k}") is not None)]
    rows = zip("ugriz", limit("avg_l"), limit("avg_h", "avg_u"), limit("min_l"), limit("min_h", "max_h"), strict=True)
    bands = [r for r in rows if r[1] <= r[2] or r[3] <= r[4]]
    keys = keys_in_order(axes)
    if not bands:
        return regions.enumerate_windows(array.cells.sparkSession, axes, area(config, p)).select(*keys)
    found = regions.region_parts(array.cells, axes, (Span(), Span()), {b[0]: F.col(b[0]) for b in bands}, keep=area(config, p))
    ok = F.lit(True)
    for b, low, high, least, most in bands:
        ok &= (F.col(f"{b}_count") > 0) & rounded(F.col(f"{b}_sum") / F.when(F.col(f"{b}_count") > 0, F.col(f"{b}_count"))).between(low, high)
        ok &= (rounded(F.col(f"{b}_min")) >= least) & (rounded(F.col(f"{b}_max")) <= most)
    return found.where(ok).select(*keys)


#: What a user's expression may name: the window's place and size and the aggregates of its values.
EXPRESSION_PARTS = ("sum", "count", "min", "max")


@task("expr:Windows", "windows:expression")
def expression_windows(array: Array, config: Config, synopses: Sequence[Synopsis] = (), p: str = "expr") -> DataFrame:
    """Windows that meet constraints which the configuration states as SQL expressions.

    ``<p>.constraints`` lists objects with name and value, an expression over x, y, lx, ly, avg, sum, count, min and max,
    and any of l, h, relax_l, relax_h, contr and strict. ``<p>.where`` is an expression over x, y, lx and ly that a window
    has to meet before its values are looked at. Windows without values are left out; a null value rejects a window.
    Columns x, y, lx, ly, the named values and, where asked for, rd and rank.
    """
    axes = window_axes(config, p)
    on = config.flag("relax.on")
    stated = config.need(f"{p}.constraints")
    names = [c["name"] for c in stated]
    taken = {*keys_in_order(axes), "avg", *EXPRESSION_PARTS}
    if len(set(names)) < len(names) or taken & set(names):
        raise ValueError(f"constraints need names of their own: {', '.join(names)}")
    keep = F.expr(config.get(f"{p}.where", "true")) & area(config, p)
    found = regions.region_parts(array.cells, axes, (Span(), Span()), {"v": F.col(config.get(f"{p}.attribute", "val"))}, EXPRESSION_PARTS, keep=keep).where("v_count > 0")
    found = found.select(*keys_in_order(axes), *[F.col(f"v_{part}").alias(part) for part in EXPRESSION_PARTS]).withColumn("avg", F.col("sum") / F.col("count"))
    constraints = []
    for c in stated:
        found = found.withColumn(c["name"], F.expr(c["value"]))
        low, high = c.get("l"), c.get("h")
        limits = (c.get("relax_l", low), c.get("relax_h", high)) if on else (low, high)
        constraints.append((Relaxable(c["name"], low, high, *limits, contract=c.get("contr", 0), strict=bool(c.get("strict")) and not on), F.col(c["name"])))
    some = F.lit(True)
    for name in names:
        some &= F.col(name).isNotNull()
    return finish(found.where(some), config, constraints, [*keys_in_order(axes), *names])


def result_strings(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows as text 'name=value, …'; rd and rank are cut to thousandths, and rank is given only where rd is 0."""
    parts = []
    for c in columns or rows.columns:
        value = F.col(c)
        if c in ("rd", "rank"):
            value = F.floor(value * 1000) / 1000
        text = F.concat(F.lit(f"{c}="), value.cast("string"))
        parts.append(F.when(F.col("rd") == 0, text) if c == "rank" and "rd" in rows.columns else text)
    return rows.select(F.concat_ws(", ", *parts).alias("assignment"))


def parse_results(rows: DataFrame, names: Sequence[str], column: str = "assignment") -> DataFrame:
    """The values of named fields from result text: whole numbers where they are, else doubles."""
    fields = F.str_to_map(F.col(column), F.lit(", "), F.lit("="))
    return rows.select(*[F.try_to_number(fields[n], F.lit("S999999999999999999")).cast("long").alias(n) if n not in ("rd", "rank") else fields[n].try_cast("double").alias(n) for n in names])


def run_file(spark: SparkSession, array: Array, spec: str, synopses: Sequence[Synopsis] = ()) -> DataFrame:
    """Results of 'library:function:file' as text."""
    return result_strings(search(array, spec, synopses=synopses))
