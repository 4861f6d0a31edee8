"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its share of the wanted rows over its rows. Each document draws
its number of copies from a Poisson distribution of that mean, by inversion of a uniform number that
is hashed from seed and id, so the draw is the same under any partitioning. Copies are exploded and
dealt out by a hashed shuffle key, in whose order each partition is written: a global shuffle.

A rate above PART is the sum of equal Poisson parts, each with a hash of its own, so the inversion
table of a source stays short. Null sources count as the source ''. Rows of null id are hashed by their
text (null: empty); repeated rows draw alike. A source without a weight gets none of the output; empty
tables give empty tables. Columns named copy or shuffle_key are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatialis.llm.common import free_name, staged

PART, SEED = 32.0, 17
#: Sources up to which their table (some 60 numbers each) is broadcast; beyond, documents are salted.
BROADCAST_SOURCES, SALTS = 10_000, 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) hashed from the parts, on a grid of 2^-52."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, rows: float | None = None, source: str = "source") -> DataFrame:
    """One row for each source: mix_source, n_rows, rate.

    `weights` name the sources' target weights; without them a weight is the source's rows to `power`.
    `rows` is the expected size of the output (default: as many rows as the input has).
    """
    own = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        own = own.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(power)))
    else:
        given = docs.sparkSession.createDataFrame([(k or "", float(v)) for k, v in weights.items()], "mix_source string, weight double")
        own = own.join(given, "mix_source").where("weight > 0")
    every = own.agg(F.sum("weight").alias("all_weight"), F.sum("n_rows").alias("all_rows"))
    wanted = F.lit(float(rows)) if rows is not None else F.col("all_rows").cast("double")
    return own.crossJoin(F.broadcast(every)).select("mix_source", "n_rows", (wanted * F.col("weight") / F.col("all_weight") / F.col("n_rows")).alias("rate"))


def _table(rate: Column) -> Column:
    """P(N <= j) for j = 0, 1, ... to where the rest is below the grid of the uniform numbers."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * rate / j
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["cdf"])


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, rows: float | None = None, seed: int = SEED, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with each row as often as drawn, with its copy number from 1 and its shuffle_key, dealt
    out at random. The sources are counted: up to BROADCAST_SOURCES their table is broadcast, beyond that
    it is joined by name and salt, so the rows of a large source are spread over SALTS tasks."""
    docs = docs.drop("copy", "shuffle_key")
    name, part, cdf, salt, key, count = (free_name(docs, f"mix_{x}") for x in ("source", "parts", "table", "salt", "key", "count"))
    rates = source_rates(docs, weights, power, rows, source)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    rates = staged(rates, "rates")
    few = rates.count() <= BROADCAST_SOURCES
    rates = rates.select(F.col("mix_source").alias(name), parts.alias(part), _table(F.col("rate") / parts).alias(cdf))
    hashed = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(part)),
        F.lit(0),
        lambda acc, i: acc + F.size(F.filter(F.col(cdf), lambda c: c <= uniform(F.lit(str(seed)), i.cast("string"), F.col(key)))),
    )
    named = docs.withColumn(name, F.coalesce(F.col(source).cast("string"), F.lit("")))
    if few:
        joined = named.join(F.broadcast(rates), name)
    else:
        salts = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = named.withColumn(salt, F.pmod(F.xxhash64(F.col(doc_id), F.length(text)), F.lit(SALTS)).cast("int")).join(salts, [name, salt])
    return (
        joined
        .withColumn(key, hashed)
        .withColumn(count, drawn)
        .where(F.col(count) > 0)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(count))))
        .withColumn("shuffle_key", F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("shuffle"), F.lit(str(seed)), key, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long"))
        .select(*docs.columns, "copy", "shuffle_key")
        .repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


#: The same rows in DuckDB, for the defaults over `documents`.
SQL = f"""
with counted as (select coalesce(source, '') as s, count(*) as n_rows from documents group by 1),
weighted as (select s, n_rows, sqrt(n_rows::double) as weight from counted),
rated as (select s, (select sum(n_rows) from weighted)::double * weight / (select sum(weight) from weighted) / n_rows as rate from weighted),
parted as (select s, rate, greatest(1, ceil(rate / {PART}))::int as parts from rated),
steps as (select s, parts, rate / parts as r, unnest(range(0, ceil(rate / parts + 12 * sqrt(rate / parts) + 20)::int + 1)) as j from parted),
mass as (select s, parts, j, exp(j * ln(r) - r - lgamma(j + 1)) as p from steps),
cdf as (select s, parts, list(c order by j) as cdf from (select s, parts, j, sum(p) over (partition by s order by j) as c from mass) group by s, parts),
keyed as (select d.*, coalesce(doc_id::varchar, 't' || md5(coalesce(text, ''))) as k, cdf.cdf, cdf.parts from documents d join cdf on coalesce(d.source, '') = cdf.s),
drawn as (select *, list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('{SEED}|' || i || '|' || k), 1, 13))::bigint / {float(1 << 52)}))))::int as n from keyed),
copied as (select *, unnest(range(1, n + 1))::int as copy from drawn where n > 0)
select doc_id, text, lang, source, n_chars, copy, ('0x' || substr(md5('shuffle|{SEED}|' || k || '|' || copy), 1, 15))::bigint as shuffle_key from copied
"""
