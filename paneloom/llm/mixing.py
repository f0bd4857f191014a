"""Mixing sources to target weights by highest quotients.

``mix`` gives every source a target in words, cuts each source's documents, laid out in seeded
order, into blocks of equal size, and hands the mix's blocks to the sources one by one: the next
block goes to the source with the highest quotient target / (2 * blocks so far + 1). The mix is
dealt into shards of equal length, and the blocks a source wins inside a shard are its quota there.
A source then draws as many of its own blocks, from a seeded first block onward and around, so that
documents stay whole but for those at the two ends.

Targets: sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of
all words; a target stops at ``cap`` times its source's words and what is over goes to the others
by weight. That is one water level, found from running sums over the sources.

The quotient order is never listed. A common multiplier says how many blocks each source has won;
a few rounds of sums over a grid of multipliers enclose each shard's end, and only the blocks between
the enclosing multipliers are ranked. Rows of a source are never gathered; running sums are taken
over ranges of the seeded order.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of
its own; repeated rows are documents of their own; a null id takes part; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.llm.shared import query, stored, table
from paneloom.operators.ranking import attach, positions, running

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARDS, SHARE, CAP, WEIGHTS, SEED = 32, 8, 1.5, 2.0, (3, 1, 2), "mix"
#: Points of each refining round between two multipliers, and rounds at most.
POINTS, ROUNDS = 16, 9


def draw(*parts: Column) -> Column:
    """60 seeded bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, share: float = SHARE, cap: float = CAP, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, place, target) of each source of (source, size) rows."""
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed = positions(sizes, [], [("source", True)], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    facts = placed.select("*", weight.alias("weight"), (F.col("source_size") * cap).alias("most"))
    sums = running(
        facts.withColumn("ratio", F.col("most") / F.col("weight")),
        [],
        [("ratio", True), ("place", True)],
        {"most_upto": F.col("most"), "weight_upto": F.col("weight")},
        totals=True,
    )
    # the level if the sources before this one are full and it and those after it are not
    before_most, before_weight = F.col("most_upto") - F.col("most"), F.col("weight_upto") - F.col("weight")
    level = (F.col("most_upto_total") * (share / cap) - before_most) / (F.col("weight_upto_total") - before_weight)
    sums = stored(sums.withColumn("level", level), "levels")
    fitting = sums.filter("level <= ratio").agg(F.min_by("level", F.struct("ratio", "place")).alias("level")).first()["level"]
    target = F.least(F.col("most"), F.col("weight") * F.lit(fitting or 0.0))
    return sums.select("source", "source_size", "place", target.alias("target"))


def won(target: Column, most: Column, multiplier: Column) -> Column:
    """Blocks whose quotient is at least 1 / (2 * multiplier)."""
    return F.least(most, F.floor(target * multiplier + 0.5))


def shard_quotas(targets: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, cap: float = CAP) -> DataFrame:
    """(place, shard, quota, upto): blocks of each source in each shard, and up to its end."""
    blocks = F.ceil(F.col("source_size") / block)
    facts = stored(targets.select("place", "target", blocks.alias("blocks"), F.floor(blocks * cap).alias("most")), "block-targets")
    whole = facts.agg(F.sum("target").alias("t"), F.sum("most").alias("m")).first()
    total = min(round((whole["t"] or 0) / block), whole["m"] or 0)
    ends = [total * s // shards for s in range(1, shards + 1)]

    def sums(points: list[float]) -> list[int]:
        grid = F.posexplode(F.array(*[F.lit(p) for p in points])).alias("k", "at")
        rows = facts.select("target", "most", grid).groupBy("k").agg(F.sum(won(F.col("target"), F.col("most"), F.col("at"))).alias("n"))
        found = {r["k"]: int(r["n"]) for r in rows.collect()}  # as many as points
        return [found.get(k, 0) for k in range(len(points))]

    points = [0.0, *[2.0**k / block for k in range(-24, 40)]]
    counts = sums(points)
    low = [max((p, n) for p, n in zip(points, counts, strict=True) if n <= e) for e in ends]
    high = [min(((p, n) for p, n in zip(points, counts, strict=True) if n >= e), default=low[i]) for i, e in enumerate(ends)]
    for _ in range(ROUNDS):
        loose = [i for i in range(shards) if high[i][1] - low[i][1] > 1]
        if not loose:
            break
        inner = {i: [low[i][0] + (high[i][0] - low[i][0]) * k / (POINTS + 1) for k in range(1, POINTS + 1)] for i in loose}
        counts = iter(sums([p for i in loose for p in inner[i]]))
        for i in loose:
            for p in inner[i]:
                n = next(counts)
                if n <= ends[i]:
                    low[i] = max(low[i], (p, n))
                else:
                    high[i] = min(high[i], (p, n))
    bounds = F.explode(
        F.array(
            *[
                F.struct(F.lit(s).alias("shard"), F.lit(low[s][0]).alias("low"), F.lit(high[s][0]).alias("high"), F.lit(ends[s] - low[s][1]).alias("need"))
                for s in range(shards)
            ]
        )
    ).alias("b")
    grid = facts.select("place", "target", "most", bounds).select("place", "target", "most", "b.*")
    sure = grid.select("*", won(F.col("target"), F.col("most"), F.col("low")).alias("sure"))
    next_ones = F.sequence(F.col("sure"), won(F.col("target"), F.col("most"), F.col("high")) - 1)
    open_ = sure.filter(won(F.col("target"), F.col("most"), F.col("high")) > F.col("sure")).select(
        "shard", "place", "need", "target", F.explode(next_ones).alias("j")
    )
    ranked = positions(
        open_.withColumn("quotient", F.col("target") / (2 * F.col("j") + 1)),
        ["shard"],
        [("quotient", False), ("place", True), ("j", True)],
    )
    more = ranked.filter("position <= need").groupBy("shard", "place").agg(F.count(F.lit(1)).alias("more"))
    upto = sure.join(more, ["shard", "place"], "left").select(
        "place", "shard", (F.col("sure") + F.coalesce(F.col("more"), F.lit(0))).alias("upto")
    )
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("place").orderBy("shard")), F.lit(0))
    return upto.select("place", "shard", (F.col("upto") - before).alias("quota"), "upto")


def mix(
    documents: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, share: float = SHARE, cap: float = CAP, weights=WEIGHTS,
    seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """Per document: its size, its source's size and target, and ``taken``, the words the mix takes.

    ``full`` counts the times the whole document is taken; ``part_from`` .. ``part_to`` and
    ``wrap_from`` .. ``wrap_to`` are the word ranges taken once more.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    named = documents.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("text_hash")
    )
    order = draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = stored(named.withColumn("order", order), "sizes")
    targets = stored(source_targets(sized.select("source", "size"), share, cap, weights), "targets")
    quotas = stored(shard_quotas(targets, block, shards, cap), "quotas")
    drawn = targets.join(quotas.groupBy("place").agg(F.max("upto").alias("drawn")), "place")
    blocks = F.ceil(F.col("source_size") / block)
    first = draw(F.lit(seed), F.lit("first"), F.coalesce(F.col("source"), F.lit("")))
    sources = drawn.select("source", "source_size", "target", "drawn", blocks.alias("blocks"), first.alias("first"))
    some = F.col("blocks") > 0
    sources = sources.select(
        "source", "source_size", "target",
        F.when(some, F.floor(F.col("drawn") / F.col("blocks"))).otherwise(0).alias("full"),
        F.when(some, F.col("first") % F.col("blocks") * block).otherwise(0).alias("run_from"),
        F.when(some, (F.col("first") % F.col("blocks") + F.col("drawn") % F.col("blocks")) * block).otherwise(0).alias("run_to"),
        (F.col("blocks") * block).alias("around"),
    )
    laid = running(sized, ["source"], [("order", True), ("doc_id", True), ("size", True), ("text_hash", True)], {"stop": F.col("size")})
    rows = attach(laid, sources, ["source"])
    start = F.col("stop") - F.col("size")

    def inside(edge: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("size"), edge - start)).cast("long")

    ranged = rows.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target", F.col("full").cast("long").alias("full"),
        inside(F.col("run_from")).alias("part_from"), inside(F.col("run_to")).alias("part_to"),
        F.lit(0).cast("long").alias("wrap_from"),
        inside(F.greatest(F.lit(0), F.col("run_to") - F.col("around"))).alias("wrap_to"),
    )
    taken = F.expr("full * size + part_to - part_from + wrap_to - wrap_from")
    return ranged.withColumn("taken", taken)


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself, with the columns of ``documents``: a row for each time a document is taken whole and
    for each part of one, whose text is then that part. ``n_chars``, if there, follows the text.

    Rows equal in id, source and text are taken together.
    """
    mixed = stored(mix(documents, id_col=id_col, text_col=text_col, source_col=source_col, **options), "mix")
    part = F.array(F.struct(F.col("part_from").alias("a"), F.col("part_to").alias("b")), F.struct(F.col("wrap_from").alias("a"), F.col("wrap_to").alias("b")))
    # a source has two ends, so few documents have parts
    parts = F.when(F.expr("part_to > part_from OR wrap_to > wrap_from"), F.filter(part, lambda p: p["b"] > p["a"]))
    keys = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash")]
    whole = F.expr("part_to - part_from = size OR wrap_to - wrap_from = size")
    ranges = F.collect_list(F.when(~whole, parts))
    times = F.sum(F.col("full") + F.when(whole & (F.col("size") > 0), 1).otherwise(0))
    takes = mixed.filter("taken > 0").groupBy(*keys).agg(times.alias("_times"), F.flatten(ranges).alias("_parts"))
    takes = stored(takes, "takes")
    same = (
        F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_source")) & F.xxhash64(text_col).eqNullSafe(F.col("_hash"))
    )
    if mixed.filter("taken > 0").count() > takes.count():
        documents = documents.dropDuplicates([id_col, source_col, text_col])
    rows = documents.join(takes, same).withColumn(
        "_part",
        F.explode(
            F.concat(F.array_repeat(F.lit(None).cast("struct<a:bigint,b:bigint>"), F.col("_times").cast("int")), F.col("_parts"))
        ),
    )
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.regexp_replace(
        F.array_join(F.slice(words, (F.col("_part.a") + 1).cast("int"), (F.col("_part.b") - F.col("_part.a")).cast("int")), ""), r"^[\x20\x09-\x0D]+", ""
    )
    rows = rows.withColumn(text_col, F.when(F.col("_part").isNull(), F.col(text_col)).otherwise(cut))
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.length(text_col).cast(documents.schema["n_chars"].dataType))
    return rows.select(*documents.columns)


#: The same by listing every block's quotient. Runs of words count as in the operator.
MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS o
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place,
         ('0x' || substr(md5('{SEED}/first/' || coalesce(source, '')), 1, 15))::BIGINT AS f
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0, 2.0][((place - 1) % 3 + 1)::INT] AS w, ceil(source_size / {BLOCK_WORDS}.0)::BIGINT AS k FROM src),
levels AS (
  SELECT (1.5::DOUBLE * (SELECT sum(source_size) FROM src)
          - coalesce((SELECT sum(2.0::DOUBLE * b.source_size) FROM weighed b
                      WHERE (2.0::DOUBLE * b.source_size / b.w, b.place) < (2.0::DOUBLE * a.source_size / a.w, a.place)), 0))
         / (SELECT sum(b.w) FROM weighed b
            WHERE (2.0::DOUBLE * b.source_size / b.w, b.place) >= (2.0::DOUBLE * a.source_size / a.w, a.place)) AS level,
         2.0::DOUBLE * a.source_size / a.w AS ratio, a.place
  FROM weighed a),
level AS (SELECT arg_min(level, (ratio, place)) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT weighed.*, least(2.0::DOUBLE * source_size, w * level) AS target FROM weighed, level),
quotients AS (
  SELECT place, target / (2 * j + 1) AS q, j FROM (SELECT place, target, unnest(range(0, 2 * k)) AS j FROM targets)),
won AS (
  SELECT place, count(*) AS n FROM (
    SELECT place, row_number() OVER (ORDER BY q DESC, place, j) AS r FROM quotients)
  WHERE r <= least((SELECT round_even(sum(target) / {BLOCK_WORDS}.0, 0) FROM targets), (SELECT sum(2 * k) FROM targets)) GROUP BY place),
drawn AS (
  SELECT t.source, t.source_size, t.target, t.k, coalesce(n, 0) // greatest(k, 1) AS full_,
         f % greatest(k, 1) AS b, coalesce(n, 0) % greatest(k, 1) AS r
  FROM targets t LEFT JOIN won USING (place)),
laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM sized)
SELECT doc_id, size, source_size, target,
  (full_ * size
   + greatest(0, least(start + size, (b + r) * {BLOCK_WORDS}) - greatest(start, b * {BLOCK_WORDS}))
   + greatest(0, least(start + size, (b + r - k) * {BLOCK_WORDS}) - start))::BIGINT AS taken
FROM laid l JOIN drawn d ON l.source IS NOT DISTINCT FROM d.source
"""


@query("op6_mixing", MIXING_SQL)
def mixing(spark, folder):
    return mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
