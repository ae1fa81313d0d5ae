"""Uniform shuffle of documents into shards of exact size.

Rows lie in logical partitions. A communication matrix says how many rows each partition sends to
each shard; it is drawn from the exact law of a uniform permutation, a chain of hypergeometric draws
under the partitions' sizes and the shards' capacities. Each partition permutes its rows and deals
them by its matrix row; each shard permutes what it got. Shard sizes differ by one row at most.

The draws run as SQL folds: one deals the shards' capacities to groups of ``GROUP`` partitions, then each
group, a row of its own, deals its share to its partitions. Their size does not depend on the rows.
A draw walks outward from the mode by the ratio of neighbouring probabilities, so nothing underflows.

Every row draws for itself: it is numbered by its place in the input, in a staged table that lost tasks read
again, so rows that are equal fall as independently as others, and many of them are no hot key. Another
order of the input gives another shuffle.

Edge cases: null text counts as empty (size 1), also a very long one is only measured; null ids are kept; equal rows
are dealt out separately; other columns, whatever their names, are ignored; ties cannot occur but in 64-bit
draws, which the row's number breaks; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows a logical partition or block holds on average, and the most partitions.
ROWS_EACH, MOST_PARTITIONS = 20_000, 65_536
#: Partitions whose draws are one fold.
GROUP = 256


def _pick(n: str, k: str, total: str, u: str, tag: str) -> str:
    """SQL: how many of ``k`` marked rows are among ``n`` drawn from ``total``, for the uniform ``u``."""
    low, high = f"greatest(0L, {n} - ({total} - {k}))", f"least({n}, {k})"
    mode = f"greatest({low}, least({high}, bigint(floor(({n} + 1D) * ({k} + 1D) / ({total} + 2D)))))"
    var = f"{n} * ({k} / {total}) * (1D - {k} / {total})"

    def up(x: str, w: str) -> str:
        return f"if({x} > {{h}}, 0D, {w} * ({k} - {x} + 1D) * ({n} - {x} + 1D) / (double({x}) * ({total} - {k} - {n} + {x})))"

    def down(x: str, w: str) -> str:
        return f"if({x} < {{l}}, 0D, {w} * ({x} + 1D) * ({total} - {k} - {n} + {x} + 1D) / (({k} - double({x})) * ({n} - double({x}))))"

    def walk(step: str, sign: str, goal: str) -> str:
        """Sum of the weights on one side (goal empty), or the first value where their sum passes the goal."""
        a, i = f"a{tag}", f"i{tag}"
        w = step(f"(m.m {sign} {i})", f"{a}.w").replace("{h}", "m.h").replace("{l}", "m.l")
        if not goal:
            return f"aggregate(m.s, named_struct('w', 1D, 't', 0D), ({a}, {i}) -> named_struct('w', {w}, 't', {a}.t + {w}), {a} -> {a}.t)"
        hit = f"if({a}.x >= 0 or {a}.t + {w} <= {goal}, {a}.x, m.m {sign} {i})"
        return f"aggregate(m.s, named_struct('w', 1D, 't', 0D, 'x', -1L), ({a}, {i}) -> named_struct('w', {w}, 't', {a}.t + {w}, 'x', {hit}), {a} -> {a}.x)"

    setup = f"named_struct('m', {mode}, 'h', {high}, 'l', {low}, 's', sequence(1L, 40L + bigint(ceil(12D * sqrt({var})))))"
    sums = f"transform(array({setup}), m -> named_struct('m', m.m, 'h', m.h, 'l', m.l, 's', m.s, 'up', {walk(up, '+', '')}, 'down', {walk(down, '-', '')}))"
    aim = f"{u} * (1D + m.up + m.down)"
    choose = f"case when {aim} < 1D then m.m when {aim} < 1D + m.up then {walk(up, '+', f'({aim} - 1D)')} else {walk(down, '-', f'({aim} - 1D - m.up)')} end"
    # rounding may leave the last step short of the goal: the far end of that side is meant then
    return f"element_at(transform({sums}, m -> coalesce(nullif({choose}, -1L), m.m)), 1)"


def matrix(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, cuts: for each partition the running totals of rows that go to shards 0, 1, ...

    ``counts`` has part (0 to P - 1, each once) and rows.
    """
    grouped = counts.withColumn("group", F.floor(F.col("part") / GROUP).cast("int"))
    among = grouped.groupBy("group").agg(F.sum("rows").alias("rows"))
    whole = among.agg(F.sort_array(F.collect_list(F.struct(F.col("group").alias("part"), "rows"))).alias("c"), F.sum("rows").alias("n")).where("size(c) > 0")
    even = F.expr(f"transform(sequence(0, {shards - 1}), s -> n div {shards} + if(s < n % {shards}, 1L, 0L))")
    shares = _dealt(whole.select(F.lit(-1).alias("g"), "c", even.alias("rem")), shards, seed).select(F.col("part").alias("group"), F.col("sent").alias("rem"))
    each = grouped.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("part", "rows"))).alias("c"))  # at most GROUP partitions
    sent = _dealt(each.join(shares, "group").select(F.col("group").alias("g"), "c", "rem"), shards, seed)
    running = "transform(sequence(1, size(sent)), i -> aggregate(slice(sent, 1, i), 0L, (x, y) -> x + y))"
    return sent.select("part", F.expr(running).alias("cuts"))


def _dealt(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """part, sent: what each part of ``c`` (part, rows) sends to each shard, if all of them send ``rem`` (g tells the rows' draws apart)."""
    u = f"shiftrightunsigned(xxhash64({seed}L, g, p, s), 11) * 1.1102230246251565E-16D"
    draw = _pick("b.left", "a.rem[s]", "b.total", u, "d")
    give = f"if(s = {shards - 1} or b.left = 0, b.left, if(a.rem[s] = 0, 0L, if(a.rem[s] = b.total, b.left, {draw})))"
    row = f"""aggregate(sequence(0, {shards - 1}),
        named_struct('left', c[p].rows, 'total', aggregate(a.rem, 0L, (x, y) -> x + y), 'row', cast(array() as array<bigint>)),
        (b, s) -> element_at(transform(array({give}), y -> named_struct('left', b.left - y, 'total', b.total - a.rem[s], 'row', concat(b.row, array(y)))), 1),
        b -> b.row)"""
    fold = f"""aggregate(sequence(0, size(c) - 1),
        named_struct('rem', rem, 'out', cast(array() as array<array<bigint>>)),
        (a, p) -> element_at(transform(array({row}), r -> named_struct('rem', zip_with(a.rem, r, (x, y) -> x - y), 'out', concat(a.out, array(r)))), 1),
        a -> a.out)"""
    drawn = rows.select("c", F.expr(fold).alias("out")).select(F.posexplode(F.arrays_zip("c", "out")).alias("i", "x"))
    return drawn.select(F.col("x.c.part").alias("part"), F.col("x.out").alias("sent"))


def shards(docs: DataFrame, n_shards: int = 8, seed: int = 20) -> DataFrame:
    """One row per document: its size, CRC-32, shard and place in the shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    total = docs.count()
    parts = min(MOST_PARTITIONS, max(16, -(-total // ROWS_EACH)))
    blocks = max(8, -(-total // (n_shards * ROWS_EACH)))
    light = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    light = staged(light.withColumn("row", F.monotonically_increasing_id()))
    light = light.withColumn("mix", F.xxhash64(F.lit(seed), F.col("row"), F.col("doc_id"), F.col("size"), F.col("text_crc32")))
    light = light.withColumn("part", F.pmod(F.shiftrightunsigned("mix", 32), F.lit(parts)).cast("int"))

    cuts = matrix(light.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), n_shards, seed)
    local = Window.partitionBy("part").orderBy("mix", "row")
    sent = (
        light.withColumn("place", F.row_number().over(local) - 1)
        .join(F.broadcast(cuts), "part")  # at most MOST_PARTITIONS rows
        .withColumn("shard", F.expr("size(filter(cuts, x -> x <= place))"))
    )
    # The second permutation: by a fresh hash, dealt in blocks so that a shard is never one task's work.
    sent = sent.withColumn("mix", F.xxhash64(F.lit(seed + 1), F.col("part"), F.col("place"))).withColumn("block", F.pmod(F.shiftrightunsigned("mix", 32), F.lit(blocks)).cast("int"))
    sent = sent.select("doc_id", "size", "text_crc32", "shard", "mix", "block", "row")
    sizes = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("mix", "row")
    return (
        sent.withColumn("place", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "block"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
