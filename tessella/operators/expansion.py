"""Contexts widened by the neighbours and the heading openers of their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sections import kind


def defaults(results: DataFrame, chunks: DataFrame, key: str = "chunk_id", source: str = "source", heading: str = "heading") -> DataFrame:
    """(query_id, has_code, has_heading): is any result code, is any prose under a heading?

    The flags hold for all results of a query.
    """
    rows = results.select("query_id", key).join(chunks.select(key, source, heading), key)
    code = kind(F.col(source)) == "code"
    prose = (kind(F.col(source)) == "prose") & (F.length(F.trim(heading)) > 0)
    return rows.groupBy("query_id").agg(
        F.coalesce(F.bool_or(code), F.lit(False)).alias("has_code"), F.coalesce(F.bool_or(prose), F.lit(False)).alias("has_heading")
    )


def plan(
    contexts: DataFrame,
    chunks: DataFrame,
    neighbours: int = 1,
    openers: bool = True,
    flags: DataFrame | None = None,
    key: str = "chunk_id",
    source: str = "doc_id",
    at: str = "piece",
    section: tuple[str, str] = ("source", "heading"),
) -> DataFrame:
    """(query_id, seed, companion, nth, step, token_count): what may join each chosen chunk, in order.

    ``nth`` is the seed's place in its context.  Neighbours in their ``source`` come first, the
    nearer before the farther and the earlier before the later; then the first chunk under the same
    ``section``.  With ``flags`` (see :func:`defaults`) only queries with code take neighbours and
    only those with headings take openers.  Null headings have no opener.
    """
    chosen = contexts.select("query_id", F.posexplode("selected").alias("nth", "seed"))
    if flags is not None:
        chosen = chosen.join(flags, "query_id")
    else:
        chosen = chosen.select("*", F.lit(True).alias("has_code"), F.lit(True).alias("has_heading"))
    columns = list(dict.fromkeys([source, at, *section]))
    seeds = chosen.join(chunks.select(F.col(key).alias("seed"), *columns), "seed")
    size = F.col("token_count").cast("long").alias("token_count")
    out = ["query_id", "seed", "companion", "nth", "step", "token_count"]
    found = None
    if neighbours > 0:
        offsets = [d for n in range(1, neighbours + 1) for d in (-n, n)]
        steps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("step")) for i, d in enumerate(offsets)]))
        places = seeds.where("has_code").select("query_id", "seed", "nth", source, at, steps.alias("o"))
        places = places.select("query_id", "seed", "nth", source, (F.col(at) + F.col("o.d")).alias(at), "o.step")
        found = places.join(chunks.select(source, at, F.col(key).alias("companion"), size), [source, at]).select(*out)
    if openers:
        least = F.min(F.struct(F.col(source).alias("s"), F.col(at).alias("p"), F.col(key).alias("companion"), size))
        first = chunks.groupBy(*section).agg(least.alias("f")).select(*section, "f.companion", "f.token_count")
        under = seeds.where("has_heading").join(first, list(section)).where("companion <> seed")
        rows = under.withColumn("step", F.lit(2 * max(neighbours, 0))).select(*out)
        found = rows if found is None else found.unionByName(rows)
    return seeds.limit(0).selectExpr("query_id", "seed", "seed AS companion", "nth", "0 AS step", "0L AS token_count") if found is None else found


def expanded(contexts: DataFrame, companions: DataFrame, chunks: DataFrame, budget: int | None, key: str = "chunk_id", source: str = "doc_id", at: str = "piece") -> DataFrame:
    """``contexts`` with the companions that fit into what is left of the budget, and ``n_expanded``.

    Companions of earlier seeds go first; each enters once, what doesn't fit is passed over.  Where
    something entered, all ids stand in the order of the corpus, ids without a chunk last; else the
    order stays.  ``total_tokens`` and ``n_selected`` are brought up to date.  A query's companions are
    at most its chosen chunks times the steps of the plan.
    """
    most = F.lit(2**62 if budget is None else budget).cast("long")
    chosen = contexts.select("query_id", F.explode("selected").alias("companion"))
    once = companions.groupBy("query_id", "companion").agg(F.min(F.struct("nth", "step")).alias("o"), F.first("token_count").alias("n"))
    fresh = once.join(chosen, ["query_id", "companion"], "left_anti")
    per = fresh.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("o", F.col("companion").alias("id"), "n"))).alias("_more"))
    start = F.struct(F.col("total_tokens").cast("long").alias("used"), F.array().cast(contexts.schema["selected"].dataType).alias("ids"))
    room = lambda a, x: F.when(a["used"] + x["n"] <= most, F.struct((a["used"] + x["n"]).alias("used"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)
    both = contexts.join(per, "query_id", "left").withColumn("_f", F.when(F.col("_more").isNull(), start).otherwise(F.aggregate("_more", start, room)))
    both = both.withColumn("_ids", F.concat("selected", F.col("_f.ids")))
    placed = both.where(F.size("_f.ids") > 0).select("query_id", F.explode("_ids").alias(key)).join(chunks.select(key, source, at), key, "left")
    order = F.struct(F.col(source).isNull().alias("u"), F.col(source).alias("s"), F.col(at).alias("p"), F.col(key).alias("id"))
    sorted_ = placed.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["id"]).alias("_sorted"))
    done = both.join(sorted_, "query_id", "left")
    new = {
        "selected": F.coalesce("_sorted", "selected"),
        "total_tokens": F.col("_f.used"),
        "n_selected": F.size("_ids").cast("long"),
        "n_expanded": F.size("_f.ids").cast("long"),
    }
    return done.select(*[new[c].alias(c) if c in new else c for c in [*contexts.columns, *[c for c in new if c not in contexts.columns]]])
